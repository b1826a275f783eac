"""The two packet decoders as table functions, for SQL users.

``register(spark)`` makes them callable: ``select * from packets, lateral decode_telemetry(data)``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..schemas import TELEMETRY
from . import klv


def _telemetry():
    names = TELEMETRY.fieldNames()

    @udtf(returnType=TELEMETRY)
    class DecodeTelemetry:
        def eval(self, packet: bytes):
            found = klv.decode_telemetry_packet(bytes(packet or b""))
            yield tuple(found.get(name) for name in names)

    return DecodeTelemetry


def _vmti():
    from ..operators.vmti import FRAME, VMTI_TARGET, StructType, decode_vmti_packet

    schema = StructType([*FRAME.fields, *VMTI_TARGET.fields])
    names = schema.fieldNames()

    @udtf(returnType=schema)
    class DecodeVmti:
        def eval(self, packet: bytes):
            for found in decode_vmti_packet(bytes(packet or b"")):
                yield tuple(found.get(name) for name in names)

    return DecodeVmti


def register(spark: SparkSession) -> None:
    spark.udtf.register("decode_telemetry", _telemetry())
    spark.udtf.register("decode_vmti", _vmti())
