"""Fixed schemas. One row of TURNS is one turn of talk."""

from pyspark.sql import types as T

TURNS = T.StructType(
    [
        T.StructField("meeting_id", T.LongType(), False),
        T.StructField("turn", T.LongType(), False),
        T.StructField("speaker", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("ended_at", T.TimestampType()),
    ]
)

ROSTER = T.StructType(
    [
        T.StructField("meeting_id", T.LongType(), False),
        T.StructField("speaker", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

AGENDA = T.StructType(
    [
        T.StructField("meeting_id", T.LongType(), False),
        T.StructField("item", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("starts_at", T.TimestampType()),
    ]
)

SENTENCES = T.StructType(
    [
        T.StructField("meeting_id", T.LongType(), False),
        T.StructField("turn", T.LongType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("sentence", T.StringType()),
    ]
)

# What the sample tables hold. `events.ts` carries no time zone.
CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# How the sample tables map to TURNS: our column -> theirs.
CONVERSATIONS_AS_TURNS = {
    "meeting_id": "conv_id",
    "turn": "turn",
    "speaker": "role",
    "text": "text",
}

EVENTS_AS_TURNS = {
    "meeting_id": "user_id",
    "turn": "event_id",
    "speaker": "event_type",
    "text": "props",
    "started_at": "ts",
}
