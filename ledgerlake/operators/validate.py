"""Message validation: parse, check in a fixed order, split sound rows from dead letters.

Everything is a column expression, so the same functions serve a batch and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas

_JSON_OPTIONS = {"allowSingleQuotes": "false"}

#: ISO 8601 date, or date and time with optional fraction and offset.
_ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?([+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)
_COMPACT_TIME = r"^[0-9]{8}(T[0-9]{6}([+-][0-9]{2}:[0-9]{2})?)?$"
_COMPACT_FORMAT = "yyyyMMdd['T'HHmmss[XXX]]"


def event_timestamp(text: Column) -> Column:
    """Time of an ISO 8601 text (``Z`` allowed, compact form allowed), null when it is not one."""
    plain = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return F.when(plain.rlike(_ISO_TIME), F.try_to_timestamp(plain)).when(
        plain.rlike(_COMPACT_TIME), F.try_to_timestamp(plain, F.lit(_COMPACT_FORMAT))
    )


def _stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed once per row.

    A one-row generator keeps the optimizer from copying the expressions into every
    filter and projection that uses them, which would parse a payload dozens of times.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _without_newline(text: Column) -> Column:
    """The format check lets one trailing newline through; the number does not carry it."""
    return F.regexp_replace(text, r"\n$", "")


#: Number of each check; a sound message has fault 0.
UNPARSEABLE, NOT_AN_OBJECT, MISSING, BAD_TYPE, BAD_STATUS, BAD_AMOUNT, BAD_CURRENCY, BAD_TIME = range(1, 9)


def check_messages(messages: DataFrame, raw: str = "data") -> DataFrame:
    """``messages`` with ``message`` (fields as text, amount and time typed), ``fault`` and ``error``.

    ``fault`` is the number of the first failed check, 0 for a sound message, and ``error``
    its reason, null for a sound message. Filter on ``fault``: the reason is then only put
    together for the rows that show it. Wrapping the payload in brackets makes trailing
    text after the first value an error.
    """
    text = F.col(raw)
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    one_object = f"array<{schemas.MESSAGE.simpleString()}>"
    read = _stage(messages, _read=F.from_json(wrapped, one_object, _JSON_OPTIONS))
    fields = F.get("_read", 0)
    field = {name: fields[name] for name in schemas.MESSAGE.names}
    typed = _stage(
        read,
        _amount=_without_newline(field["amount"]).try_cast(schemas.MONEY),
        _event_time=event_timestamp(field["event_time"]),
    )
    checked = _stage(typed, fault=_fault(text, wrapped, field))
    message = F.struct(
        *[c.alias(name) for name, c in field.items()],
        F.col("_amount").alias("amount_value"),
        F.col("_event_time").alias("event_at"),
    )
    return checked.withColumns({"message": message, "error": _reason(F.col("fault"), field)}).drop(
        "_read", "_amount", "_event_time"
    )


def _fault(text: Column, wrapped: Column, field: dict[str, Column]) -> Column:
    """Number of the first failed check, 0 when all pass."""
    outline = F.btrim(text, F.lit(" \t\r\n"))
    other = F.try_parse_json(wrapped)
    single_value = (outline != "") & other.isNotNull() & F.try_variant_get(other, "$[1]", "variant").isNull()
    single_object = (F.size("_read") == 1) & F.get("_read", 0).isNotNull()
    is_json = F.is_valid_utf8(text) & (single_object | single_value)
    some_absent = F.lit(False)
    for name in schemas.REQUIRED_MESSAGE_FIELDS:
        some_absent = some_absent | (F.coalesce(field[name], F.lit("")) == "")
    checks = {
        UNPARSEABLE: ~F.coalesce(is_json, F.lit(False)),
        NOT_AN_OBJECT: ~(outline.startswith("{") & outline.endswith("}")),
        MISSING: some_absent,
        BAD_TYPE: ~field["txn_type"].isin(*schemas.TXN_TYPES),
        BAD_STATUS: ~field["status"].isin(*schemas.TXN_STATUSES),
        BAD_AMOUNT: ~field["amount"].rlike(schemas.AMOUNT_FORMAT) | F.col("_amount").isNull(),
        BAD_CURRENCY: ~field["currency"].rlike(schemas.CURRENCY_FORMAT),
        BAD_TIME: F.col("_event_time").isNull(),
    }
    return F.coalesce(*[F.when(failed, F.lit(number)) for number, failed in checks.items()], F.lit(0))


def _reason(fault: Column, field: dict[str, Column]) -> Column:
    """Reason of a fault, null for 0."""
    absent = F.concat_ws(
        "', '",
        *[
            F.when(F.coalesce(field[name], F.lit("")) == "", F.lit(name))
            for name in schemas.REQUIRED_MESSAGE_FIELDS
        ],
    )
    # ---- fixed values: wording of each reason ----
    reasons = {
        UNPARSEABLE: F.lit("unparseable payload"),
        NOT_AN_OBJECT: F.lit("payload is not a JSON object"),
        MISSING: F.concat(F.lit("missing required fields: ['"), absent, F.lit("']")),
        BAD_TYPE: F.concat(F.lit("invalid txn_type: "), field["txn_type"]),
        BAD_STATUS: F.concat(F.lit("invalid status: "), field["status"]),
        BAD_AMOUNT: F.concat(F.lit("invalid amount format: "), field["amount"]),
        BAD_CURRENCY: F.concat(F.lit("invalid currency: "), field["currency"]),
        BAD_TIME: F.concat(F.lit("invalid event_time: "), field["event_time"]),
    }
    return F.coalesce(*[F.when(fault == number, reason) for number, reason in reasons.items()])


def conform(checked: DataFrame, *keep: str) -> DataFrame:
    """Sound rows of :func:`check_messages` in silver types, with the columns in ``keep``."""
    f = F.col("message")
    return checked.where(F.col("fault") == 0).select(
        *keep,
        f["transaction_id"].alias("transaction_id"),
        f["idempotency_key"].alias("idempotency_key"),
        f["account_id"].alias("account_id"),
        f["txn_type"].alias("txn_type"),
        f["amount_value"].alias("amount"),
        f["currency"].alias("currency"),
        f["counterparty_account"].alias("counterparty_account"),
        f["status"].alias("status"),
        f["event_at"].alias("event_time"),
    )


def stamp_lineage(
    rows: DataFrame, source_system: str = "synthetic-generator", ingest_time: Column | None = None
) -> DataFrame:
    """Add ingest time, source system and pipeline version."""
    return rows.withColumns(
        {
            "ingest_time": F.current_timestamp() if ingest_time is None else ingest_time,
            "source_system": F.lit(source_system),
            "pipeline_version": F.lit(schemas.PIPELINE_VERSION),
        }
    )


def dead_letters(checked: DataFrame, raw: str = "data", failed_at: Column | None = None) -> DataFrame:
    """Rejected rows of :func:`check_messages`: the envelope's columns and its JSON text."""
    at = F.current_timestamp() if failed_at is None else failed_at
    columns = {
        "error": F.col("error"),
        "payload": F.make_valid_utf8(F.col(raw)),
        "failed_at": at,
        "pipeline_version": F.lit(schemas.PIPELINE_VERSION),
    }
    rejected = checked.where(F.col("fault") > 0).select(
        *[c.alias(name) for name, c in columns.items()]
    )
    return rejected.withColumn("envelope", F.to_json(F.struct(*columns)))
