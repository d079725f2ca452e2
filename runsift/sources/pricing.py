"""Price list: model ids, aliases and rates per million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICING_DATE = "2026-11-06"
DEFAULT_MODEL = "claude-3-5-sonnet-20241022"

# Id, aliases, name, provider, then USD per million tokens for
# input, output, cache read and cache write.
MODELS = [
    ("claude-3-5-sonnet-20241022", ["claude-3-5-sonnet", "sonnet-3-5", "claude-sonnet", "sonnet"], "Claude 3.5 Sonnet",
     "Anthropic", 3.00, 15.00, 0.30, 3.75),
    ("claude-3-5-haiku-20241022", ["claude-3-5-haiku", "haiku-3-5", "claude-haiku", "haiku"], "Claude 3.5 Haiku",
     "Anthropic", 0.80, 4.00, 0.08, 1.00),
    ("claude-3-opus-20240229", ["claude-3-opus", "opus"], "Claude 3 Opus", "Anthropic", 15.00, 75.00, 1.50, 18.75),
    ("gpt-4o-2024-11-20", ["gpt-4o", "4o"], "GPT-4o", "OpenAI", 2.50, 10.00, 1.25, 2.50),
    ("gpt-4o-mini-2024-07-18", ["gpt-4o-mini", "4o-mini"], "GPT-4o mini", "OpenAI", 0.15, 0.60, 0.075, 0.15),
    ("o1-2024-12-17", ["o1"], "OpenAI o1", "OpenAI", 15.00, 60.00, 7.50, 15.00),
    ("o1-mini-2024-09-12", ["o1-mini"], "OpenAI o1-mini", "OpenAI", 1.10, 4.40, 0.55, 1.10),
    ("gemini-1.5-pro-002", ["gemini-1.5-pro", "gemini-pro"], "Gemini 1.5 Pro", "Google", 1.25, 5.00, 0.3125, 1.25),
    ("gemini-1.5-flash-002", ["gemini-1.5-flash", "gemini-flash"], "Gemini 1.5 Flash", "Google",
     0.075, 0.30, 0.01875, 0.075),
    ("deepseek-chat", ["deepseek-v3", "deepseek"], "DeepSeek-V3", "DeepSeek", 0.14, 0.28, 0.014, 0.14),
    ("deepseek-reasoner", ["deepseek-r1", "r1"], "DeepSeek-R1", "DeepSeek", 0.55, 2.19, 0.14, 0.55),
]

_SCHEMA = ("id string, aliases array<string>, name string, provider string, input_cost_per_million double, "
           "output_cost_per_million double, cache_read_cost_per_million double, cache_write_cost_per_million double")


def models_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, _SCHEMA).withColumn("effective_date", F.lit(PRICING_DATE))


def load_pricing(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Price list from JSON documents with a ``models`` array: a document a file, or a document a line."""
    fields = ", ".join(f"{c.split()[0]}: {' '.join(c.split()[1:])}" for c in [*_SCHEMA.split(", "), "effective_date string"])
    doc = spark.read.schema(f"models array<struct<{fields}>>").json(path, multiLine=whole_file)
    return doc.select(F.explode("models").alias("m")).select("m.*")
