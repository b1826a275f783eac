"""Fixed values the results depend on, as published in the standards and tables they come from."""

# File extension -> media type.  Transport streams first: `.ts` in a video store is not TypeScript.
MEDIA_TYPES = {
    "ts": "video/mp2t", "m2ts": "video/mp2t", "mts": "video/mp2t",
    "mp4": "video/mp4", "m4v": "video/x-m4v", "mov": "video/quicktime", "avi": "video/x-msvideo",
    "mkv": "video/x-matroska", "webm": "video/webm", "wmv": "video/x-ms-wmv", "flv": "video/x-flv",
    "mpeg": "video/mpeg", "mpg": "video/mpeg", "3gp": "video/3gpp", "ogv": "video/ogg",
    "mp3": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/x-aac", "wav": "audio/x-wav",
    "flac": "audio/x-flac", "ogg": "audio/ogg", "oga": "audio/ogg", "opus": "audio/ogg",
    "wma": "audio/x-ms-wma", "mid": "audio/midi", "midi": "audio/midi", "aif": "audio/x-aiff", "aiff": "audio/x-aiff",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff",
    "svg": "image/svg+xml", "svgz": "image/svg+xml", "ico": "image/x-icon", "psd": "image/vnd.adobe.photoshop",
    "pdf": "application/pdf", "json": "application/json", "xml": "application/xml", "xsl": "application/xml",
    "js": "application/javascript", "zip": "application/zip", "gz": "application/x-gzip", "tar": "application/x-tar",
    "bz2": "application/x-bzip2", "7z": "application/x-7z-compressed", "rar": "application/x-rar-compressed",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "rtf": "application/rtf", "exe": "application/x-msdownload", "wasm": "application/wasm",
    "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "txt": "text/plain",
    "text": "text/plain", "log": "text/plain", "conf": "text/plain", "tsv": "text/tab-separated-values",
    "ics": "text/calendar", "vcf": "text/x-vcard", "c": "text/x-c", "h": "text/x-c", "java": "text/x-java-source",
    "kml": "application/vnd.google-earth.kml+xml", "kmz": "application/vnd.google-earth.kmz",
    "eps": "application/postscript", "ps": "application/postscript", "epub": "application/epub+zip",
}

UNKNOWN_TYPE = "application/octet-stream"

# Leading bytes in hexadecimal at byte offsets -> media type, for formats one signature decides.
MAGIC_BYTES = [
    (((0, "FFD8FF"),), "image/jpeg"),
    (((0, "89504E470D0A1A0A"),), "image/png"),
    (((0, "474946383761"),), "image/gif"),
    (((0, "474946383961"),), "image/gif"),
    (((0, "38425053"),), "image/vnd.adobe.photoshop"),
    (((0, "00000100"),), "image/x-icon"),
    (((0, "0000000C6A5020200D0A870A"),), "image/jp2"),
    (((0, "52494646"), (8, "57454250")), "image/webp"),
    (((4, "6674797068656963"),), "image/heic"),
    (((4, "6674797061766966"),), "image/avif"),
    (((0, "41542654464F524D"),), "image/vnd.djvu"),
    (((0, "762F3101"),), "image/aces"),
    (((0, "000001BA"),), "video/mpeg"),
    (((0, "000001B3"),), "video/mpeg"),
    (((0, "464C5601"),), "video/x-flv"),
    (((0, "1A45DFA3"),), "video/x-matroska"),
    (((0, "52494646"), (8, "41564920")), "video/x-msvideo"),
    (((4, "6674797069736F6D"),), "video/mp4"),
    (((4, "667479706D703431"),), "video/mp4"),
    (((4, "667479706D703432"),), "video/mp4"),
    (((4, "667479704D345620"),), "video/x-m4v"),
    (((4, "6674797071742020"),), "video/quicktime"),
    (((4, "6674797033677034"),), "video/3gpp"),
    (((4, "6674797033677035"),), "video/3gpp"),
    (((0, "47"), (188, "47"), (376, "47")), "video/mp2t"),
    (((0, "494433"),), "audio/mpeg"),
    (((0, "664C6143"),), "audio/flac"),
    (((0, "4F676753"),), "audio/ogg"),
    (((0, "4D546864"),), "audio/midi"),
    (((0, "52494646"), (8, "57415645")), "audio/x-wav"),
    (((0, "464F524D"), (8, "41494646")), "audio/x-aiff"),
    (((0, "2321414D52"),), "audio/amr"),
    (((0, "2E736E64"),), "audio/basic"),
    (((4, "667479704D344120"),), "audio/mp4"),
    (((0, "25504446"),), "application/pdf"),
    (((0, "1F8B08"),), "application/gzip"),
    (((0, "377ABCAF271C"),), "application/x-7z-compressed"),
    (((0, "526172211A07"),), "application/x-rar-compressed"),
    (((0, "425A68"),), "application/x-bzip2"),
    (((0, "FD377A585A00"),), "application/x-xz"),
    (((0, "28B52FFD"),), "application/zstd"),
    (((0, "04224D18"),), "application/x-lz4"),
    (((0, "4C5A4950"),), "application/x-lzip"),
    (((0, "4D534346"),), "application/vnd.ms-cab-compressed"),
    (((0, "EDABEEDB"),), "application/x-rpm"),
    (((257, "7573746172"),), "application/x-tar"),
    (((0, "0061736D"),), "application/wasm"),
    (((0, "7F454C46"),), "application/x-elf"),
    (((0, "3C3F786D6C20"),), "application/xml"),
    (((0, "7B5C72746631"),), "application/rtf"),
    (((0, "252150532D41646F6265"),), "application/postscript"),
    (((0, "53514C69746520666F726D6174203300"),), "application/vnd.sqlite3"),
    (((0, "435753"),), "application/x-shockwave-flash"),
    (((0, "465753"),), "application/x-shockwave-flash"),
    (((128, "4449434D"),), "application/dicom"),
    (((0, "894844460D0A1A0A"),), "application/x-hdf5"),
    (((0, "43444601"),), "application/x-netcdf"),
    (((0, "53494D504C4520203D"),), "application/fits"),
    (((0, "50415231"),), "application/vnd.apache.parquet"),
    (((0, "4F626A01"),), "application/vnd.apache.avro"),
    (((0, "4F524300"),), "application/vnd.apache.orc"),
    (((0, "D4C3B2A1"),), "application/vnd.tcpdump.pcap"),
    (((0, "A1B2C3D4"),), "application/vnd.tcpdump.pcap"),
    (((0, "676C5446"),), "model/gltf-binary"),
    (((0, "774F4646"),), "font/woff"),
    (((0, "774F4632"),), "font/woff2"),
    (((0, "4F54544F"),), "font/otf"),
    (((0, "3C21444F43545950452068746D6C"),), "text/html"),
    (((0, "3C68746D6C"),), "text/html"),
    (((0, "424547494E3A5643415244"),), "text/vcard"),
    (((0, "424547494E3A5643414C454E444152"),), "text/calendar"),
]

# COCO category id -> name (1..90, with gaps); the dense 0..79 table is the same names in order.
COCO = {
    1: "person", 2: "bicycle", 3: "car", 4: "motorcycle", 5: "airplane", 6: "bus", 7: "train", 8: "truck",
    9: "boat", 10: "traffic light", 11: "fire hydrant", 13: "stop sign", 14: "parking meter", 15: "bench",
    16: "bird", 17: "cat", 18: "dog", 19: "horse", 20: "sheep", 21: "cow", 22: "elephant", 23: "bear",
    24: "zebra", 25: "giraffe", 27: "backpack", 28: "umbrella", 31: "handbag", 32: "tie", 33: "suitcase",
    34: "frisbee", 35: "skis", 36: "snowboard", 37: "sports ball", 38: "kite", 39: "baseball bat",
    40: "baseball glove", 41: "skateboard", 42: "surfboard", 43: "tennis racket", 44: "bottle", 46: "wine glass",
    47: "cup", 48: "fork", 49: "knife", 50: "spoon", 51: "bowl", 52: "banana", 53: "apple", 54: "sandwich",
    55: "orange", 56: "broccoli", 57: "carrot", 58: "hot dog", 59: "pizza", 60: "donut", 61: "cake", 62: "chair",
    63: "couch", 64: "potted plant", 65: "bed", 67: "dining table", 70: "toilet", 72: "tv", 73: "laptop",
    74: "mouse", 75: "remote", 76: "keyboard", 77: "cell phone", 78: "microwave", 79: "oven", 80: "toaster",
    81: "sink", 82: "refrigerator", 84: "book", 85: "clock", 86: "vase", 87: "scissors", 88: "teddy bear",
    89: "hair drier", 90: "toothbrush",
}
COCO_NAMES = list(COCO.values())

MODEL_ALIASES = {"rf-detr": "rf-detr", "rfdetr": "rf-detr", "yolo26": "yolo26", "yolo": "yolo26"}

CLASSIFICATIONS = ["UNCLASSIFIED", "RESTRICTED", "CONFIDENTIAL", "SECRET", "TOP SECRET"]

# Documents that live streams produce carry these metadata keys.
STREAM_KEY = "Live stream"
STARTED_KEY = "Recording started"
DETECTION_KEY = "Detection"

SYNTHETIC_DESIGNATION = "SYNTHESISED STATIC SENSOR"
TRACKER_NAME = "ByteTrack (Zhang et al., ECCV 2022)"

# Universal keys of the two KLV local sets (MISB ST 0601 and ST 0903).
ST0601_KEY = bytes.fromhex("060E2B34020B01010E01030101000000")
ST0903_KEY = bytes.fromhex("060E2B34020B01010E01030306000000")

# Fixed output: what a refused source and a refused stream name are told. Callers and tests compare these texts.
SOURCE_REFUSALS = {
    "transport": ("Transport '", "' is not allowed. Allowed: {allowed}."),
    "same id": ("Two forwards share the id '", "'."),
    "no url": "A forward needs a URL.",
    "latitude": "A sensor latitude is -90 to 90 degrees.",
    "longitude": "A sensor longitude is -180 to 180 degrees.",
    "altitude": "A sensor altitude is -900 to 19000 metres.",
    "bearing": "A true bearing is 0 to 360 degrees.",
    "elevation": "A relative elevation is -180 to 180 degrees, positive above the horizon.",
    "field of view": "A field of view is above 0 and up to 180 degrees.",
    "classification": ("'", "' is not an ST 0102 classification. One of: {allowed}."),
    "name": ("'", "' is not a usable stream name."),
}
NAME_REFUSALS = {
    "unusable": ("'", "' is not a usable stream name; "),
    "letters": "allowed are letters, digits, dot, dash, underscore and slash, up to 128 of them",
    "slashes": "a slash must separate two non-empty segments and '..' is not one of them",
    "publish": "the caller asked to receive (m=request) and this is the ingest port",
    "subscribe": "the caller offered to send (m=publish) and this is the consumption port",
    "none": "no stream identifier was presented",
    "long": "the stream identifier is longer than {most} bytes",
    "empty": "the stream identifier is empty, so the stream has no name",
    "no resource": "the stream identifier carries no resource key (r), so the stream has no name",
}

NOTE_TRUNCATED = "Truncated: the recorder could not keep up with the stream."
NOTE_FAILED = (
    "Incomplete: this recording failed before it finished, so it is short of what was "
    "asked for. What is here was captured and stored before that."
)
NOTE_FAILED_TRUNCATED = (
    "Incomplete: the recorder could not keep up with the stream, and then the recording "
    "failed before it finished. It is short of what was asked for."
)

BEAT_BOUNDS_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]
