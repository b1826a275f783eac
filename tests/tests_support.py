"""Scenes shared by the tracking and streaming tests."""

from test_tracking import one_pass as one_pass_tracks
from test_tracking import random_scene

__all__ = ["one_pass_tracks", "random_scene"]
