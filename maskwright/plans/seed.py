"""Turns with personal data in them, derived from the ``conversations`` table.

The table itself holds none, so every check would compare nothing.  The text
below runs in Spark (session time zone UTC) and in DuckDB; only the name of the
function that turns epoch seconds into a time stamp differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.tables import read_table

SEEDED_TURNS = """
SELECT conv_id, turn, role,
  CASE conv_id % 4 WHEN 0 THEN 'claude.ai' WHEN 1 THEN 'chat.openai.com'
       WHEN 2 THEN 'gemini.google.com' ELSE 'wiki.internal.example.com' END AS domain,
  {epoch_seconds} AS ts,
  concat(text, CASE
   WHEN role = 'user' THEN CASE (conv_id * 5 + turn) % 13
    WHEN 0 THEN concat(' mail user', cast(conv_id as string), '@example.com')
    WHEN 1 THEN concat(' call (555) 123-', lpad(cast(conv_id % 10000 as string), 4, '0'))
    WHEN 2 THEN concat(' SSN: 123-45-', lpad(cast(conv_id % 10000 as string), 4, '0'),
                       ' and again 123-45-', lpad(cast(conv_id % 10000 as string), 4, '0'))
    WHEN 3 THEN ' card 4111 1111 1111 1111 or 4111111111111111'
    WHEN 4 THEN concat(' host 10.0.', cast(conv_id % 256 as string), '.', cast(turn as string))
    WHEN 5 THEN concat(' v6 ::1:', cast(turn as string), ' and 2001:0db8:0:0:0:0:0:1')
    WHEN 6 THEN concat(' DOB: 01/15/', cast(1950 + conv_id % 50 as string))
    WHEN 7 THEN concat(' iban GB29NWBK6016133192', lpad(cast(conv_id % 10000 as string), 4, '0'))
    WHEN 8 THEN concat(' passport AB', lpad(cast(conv_id % 10000 as string), 7, '0'))
    WHEN 9 THEN concat(' key sk-TESTONLY_abcdef', cast(conv_id as string))
    WHEN 10 THEN ' My boss and my daughter know I live in Austin, I work at a firm'
    WHEN 11 THEN ' I study at a college, I grew up in Ohio and my doctor agrees'
    ELSE ' a@b.com then a@b.com and 5551234567@example.com' END
   WHEN role = 'assistant' THEN CASE turn % 3
    WHEN 0 THEN ' You asked about [EMAIL_01] and [SSN_01].'
    WHEN 1 THEN ' Noted: [PHONE_01], [IBAN_01], [EMAIL_01].'
    ELSE ' The SSN 123-45-6789 was mentioned.' END
   ELSE '' END) AS text
FROM conversations
"""

# What a seeded prompt contains, by (conv_id * 5 + turn) % 13.
SEEDED_TYPES = (
    ("EMAIL",), ("PHONE",), ("SSN",), ("CREDIT_CARD",), ("IP_ADDRESS",), ("IP_ADDRESS_V6",),
    ("DATE_OF_BIRTH",), ("IBAN",), ("PASSPORT",), ("API_KEY",), (), (), ("EMAIL",),
)


_SECONDS = "1704067200 + conv_id * 3600 + turn * 30"
SPARK_SQL = SEEDED_TURNS.format(epoch_seconds=f"timestamp_seconds({_SECONDS})")
DUCKDB_SQL = SEEDED_TURNS.format(epoch_seconds=f"make_timestamp(({_SECONDS}) * 1000000)")


def seeded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id", "turn")
    return spark.sql(SPARK_SQL.replace("FROM conversations", "FROM {conversations}"), conversations=conversations)
