"""Small value functions: models, providers, dates, rounding, token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import trim

# fixed values: the translators and the models that stand for them
TRANSLATORS = (
    ("879", "GPT 5o", "OpenAI"),
    ("890", "Gemini 3.0 Pro", "Gemini"),
    ("893", "OpenAI GPT 5.2 Thinking", "OpenAI"),
    ("895", "Grok 4 Expert", "Grok"),
    ("900", "GPT 5.4 Thinking", "OpenAI"),
    ("901", "Gemini 3.1 Pro", "Gemini"),
    ("903", "GPT 5.4 Pro", "OpenAI"),
    ("904", "GPT 5.4 Thinking Mini", "OpenAI"),
)
MODEL_TRANSLATORS = {"gemini-3-pro": 901, "gemini-3.1-pro": 901, "gpt-5-4-pro": 903, "gpt-5-4-thinking": 900, "gpt-5-4-t-mini": 904, "grok-4": 895}
MODEL_PLACEHOLDERS = ("auto", "unknown", "snapshot")
_OPENAI = "^(gpt|o1|o3|o4|o5)"


def model_name(c: Column) -> Column:
    """A model's name without white space around it; null for placeholders and blanks."""
    name = trim(c)
    return F.when((name != "") & ~F.lower(name).isin(*MODEL_PLACEHOLDERS), name)


def is_openai(model: Column) -> Column:
    lower = F.lower(model)
    return F.coalesce(lower.rlike(_OPENAI) | lower.contains("chatgpt"), F.lit(False))


def provider(model: Column) -> Column:
    lower = F.lower(model)
    return (
        F.when(lower.contains("gemini") | lower.contains("bard"), "Gemini")
        .when(lower.contains("grok"), "Grok")
        .when(is_openai(model), "ChatGPT")
        .otherwise("Unknown")
    )


def platform(model: Column) -> Column:
    """The platform of a model by the words in its name; null if none fits."""
    return F.nullif(provider(model), F.lit("Unknown"))


def translator_id(model: Column) -> Column:
    """The translator that a model stands for; null if it stands for none."""
    out = F.lit(None).cast("int")
    for name, number in MODEL_TRANSLATORS.items():
        out = F.when(model == name, number).otherwise(out)
    return out


def translators(spark: SparkSession) -> DataFrame:
    """(id, label, provider): the dimension of translators, eight rows."""
    return spark.createDataFrame(list(TRANSLATORS), "id string, label string, provider string")


def round_half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def iso_seconds(c: Column) -> Column:
    """Epoch seconds of an ISO-8601 text; null if it isn't one."""
    return F.floor(F.unix_millis(F.try_to_timestamp(c)) / 1000)


def iso_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_key(seconds: Column) -> Column:
    """The UTC day of epoch seconds (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def period_label(day: Column, granularity: Column) -> Column:
    date = F.to_date(day)
    return (
        F.when(granularity == "week", F.concat(F.lit("Week of "), F.date_format(date, "MMM d")))
        .when(granularity == "month", F.date_format(date, "MMM yyyy"))
        .otherwise(F.date_format(date, "MMM d"))
    )


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss 'UTC'")


def duration_text(seconds: Column) -> Column:
    """`1d 2h 3m`; parts that are 0 are left out, and 0m stands for none."""
    s = seconds.cast("long")
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))) for n, unit in ((F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m"))]
    text = F.concat_ws(" ", *parts)
    return F.when(s.isNull(), None).when(text == "", "0m").otherwise(text)


def thinking_bucket(seconds: Column) -> Column:
    """The bucket of a thinking time; null for none, NaN and negative times."""
    ok = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds >= 0)
    return F.when(ok, F.when(seconds < 10, "lt_10s").when(seconds < 30, "10_to_30s").when(seconds < 60, "30_to_60s").otherwise("1m_plus"))


def estimate_tokens(c: Column) -> Column:
    """The default estimate: four characters a token."""
    return F.ceil(F.length(c) / 4).cast("long")


Estimator = Callable[[Column], Column]


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
