"""A small made-up corpus with questions whose source is known, for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = {
    "harbor-overview.md": """# Harbor overview
The Harbor platform ships parcels between island depots. Harbor Router plans every trip and writes it to the Tide Ledger.
The Tide Ledger keeps each parcel event for ninety days and is replicated to three depots.
Gull Gateway receives bookings from shops and hands them to Harbor Router.""",
    "harbor-operations.md": """# Operations
When Gull Gateway fails, bookings wait in the Pebble Queue until a second gateway takes over.
Pebble Queue keeps bookings for six hours and alerts the crew after ten minutes.
A crew restores the Tide Ledger from the nearest depot, which takes about twenty minutes.""",
    "harbor-security.txt": """Every shop signs its bookings with a key that Harbor renews every thirty days.
Harbor Router rejects a booking whose signature is older than five minutes.
Only the crew lead may read customer addresses, and each reading is written to the Tide Ledger.""",
    "harbor-billing.txt": """Invoices are made on the first day of each month from the events in the Tide Ledger.
A parcel that arrives two days late is carried free of charge.
港口平台的账单每月第一天生成。""",
}
QUESTIONS = [
    ("Which component plans the trips of parcels?", "harbor-overview.md"),
    ("What happens to bookings when Gull Gateway fails?", "harbor-operations.md"),
    ("How often does Harbor renew the key of a shop?", "harbor-security.txt"),
    ("When are invoices made?", "harbor-billing.txt"),
    ("账单每月什么时候生成？", "harbor-billing.txt"),
]
#: A question that nothing in the corpus answers.
UNKNOWN = "How tall do giraffes grow?"


def documents(spark: SparkSession) -> DataFrame:
    """filename, bytes, page, text, status, as read_texts gives them."""
    rows = [(name, len(text.encode()), 1, text, "ok") for name, text in DOCUMENTS.items()]
    return spark.createDataFrame(rows, "filename string, bytes long, page int, text string, status string")


def questions(spark: SparkSession) -> DataFrame:
    """qid, text, expected (filename)."""
    return spark.createDataFrame([(i, q, name) for i, (q, name) in enumerate(QUESTIONS)], "qid int, text string, expected string")
