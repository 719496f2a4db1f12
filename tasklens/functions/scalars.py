"""Scalar functions as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_BYTES, SHOWN, OUTPUT_BYTES = 4096, 80, 64 << 10
DAY_S, WEEK_S = 86_400, 604_800


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncated(text: Column | str, most: int = MESSAGE_BYTES) -> Column:
    """The longest beginning of a text that has `most` UTF-8 bytes or fewer; no character is cut.

    The bytes are cut at `most`, less up to three that begin a character they don't end.
    """
    raw = _col(text).cast("binary")
    byte = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int")
    # the first byte left out tells whether the cut falls inside a character; going back, so do continuation bytes
    inside = lambda k: (byte(k) >= 128) & (byte(k) < 192)
    back = F.when(~inside(most + 1), 0).when(~inside(most), 1).when(~inside(most - 1), 2).otherwise(3)
    return F.when(F.octet_length(_col(text)) <= most, _col(text)).otherwise(F.decode(F.substr(raw, F.lit(1), F.lit(most) - back), "UTF-8"))


def shown(text: Column | str, most: int = SHOWN) -> Column:
    """A text cut to `most` characters, the last of them an ellipsis."""
    return F.when(F.char_length(_col(text)) > most, F.concat(F.substring(_col(text), 1, most - 1), F.lit("…"))).otherwise(_col(text))


def backoff_s(attempt: Column | str, base: int, most: int) -> Column:
    """base * 2^(attempt - 1), at most `most`; attempts below 1 count as 1, and no attempt overflows."""
    power = F.least(F.greatest(_col(attempt), F.lit(1)) - 1, F.lit(40)).cast("int")
    return F.least(F.lit(most).cast("bigint"), F.lit(base).cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), power))


def jittered(ms: Column | str, key: Column | str) -> Column:
    """A duration of 75 to 125 % of ms, by a hash of key, so that it is the same on every run."""
    return (_col(ms) * (F.lit(750) + F.pmod(F.xxhash64(_col(key)), F.lit(501))) / 1000).cast("bigint")


def poll_ladder(misses: Column | str, base_ms: int, most_ms: int) -> tuple[Column, Column]:
    """The wait after so many empty polls, and whether it is at its greatest."""
    wait = backoff_s(_col(misses), base_ms, most_ms)
    return wait, wait >= most_ms


def human_seconds(text: Column | str) -> Column:
    """Seconds of 30s, 5m, 24h, 1.5h30m, 14d or 2w; days and weeks are whole numbers; null for anything else, 0 for an empty text."""
    t = F.trim(_col(text))
    whole = F.regexp_extract(t, r"^(-?\d+)[dw]$", 1)
    unit = lambda u, s: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, rf"(\d+(?:\.\d+)?){u}(?![a-z])", 1), F.lit("")), F.lit("9999999999.999999")).cast("double"), F.lit(0.0)) * s
    parts = unit("h", 3600) + unit("m", 60) + unit("s", 1) + unit("ms", 0.001)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(t == "", F.lit(0.0))
        .when(whole != "", F.nullif(whole, F.lit("")).cast("double") * F.when(t.endswith("d"), DAY_S).otherwise(WEEK_S))
        .when(t.rlike(r"^-?(?:\d+(?:\.\d+)?h)?(?:\d+(?:\.\d+)?m)?(?:\d+(?:\.\d+)?s)?(?:\d+(?:\.\d+)?ms)?$"), sign * parts)
    )


def or_default(value: Column | str, default, blank) -> Column:
    """value, or default where it is null or blank (an empty text, 0)."""
    return F.coalesce(F.nullif(_col(value), F.lit(blank)), F.lit(default))


def positive_or(value: Column | str, default) -> Column:
    return F.when(_col(value) > 0, _col(value)).otherwise(F.lit(default))


def resolved_timeout_ms(own: Column | str, of_kind: Column | str, default: int) -> Column:
    """The first that is above 0: the job's, its kind's, the default."""
    return F.coalesce(F.when(_col(own) > 0, _col(own)), F.when(_col(of_kind) > 0, _col(of_kind)), F.lit(default))


def lease_ms(work_ms: Column | str, jitter_ms: Column | str) -> Column:
    return F.greatest(F.lit(5000), 4 * (_col(work_ms) + _col(jitter_ms)))


def heartbeat_ms(asked_ms: Column | str, lease: Column | str) -> Column:
    """Off (0) below 0, as asked above 0, else a third of the lease and at least a second."""
    return F.when(_col(asked_ms) < 0, 0).when(_col(asked_ms) > 0, _col(asked_ms)).otherwise(F.greatest(F.lit(1000), (_col(lease) / 3).cast("bigint")))


def lag_text(seconds: Column | str) -> Column:
    return F.when(_col(seconds) <= 0, "none").otherwise(F.concat(F.round(_col(seconds)).cast("bigint").cast("string"), F.lit("s")))


def cadence_text(interval_s: Column | str, cron: Column | str) -> Column:
    return F.when(F.coalesce(_col(interval_s), F.lit(0)) > 0, F.concat(F.lit("every "), _col(interval_s).cast("string"), F.lit("s"))).otherwise(F.coalesce(_col(cron), F.lit("")))


def bucket_key(slug: Column | str, at: Column | str) -> Column:
    """slug@unix seconds."""
    return F.concat(_col(slug), F.lit("@"), F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), _col(at)).cast("string"))


def is_success_status(status: Column | str, listed: Column | None = None) -> Column:
    """Whether an HTTP status is one of those listed, or 2xx where none are."""
    plain = _col(status).between(200, 299)
    return plain if listed is None else F.when(F.size(listed) > 0, F.array_contains(listed, _col(status))).otherwise(plain)


def class_of_exit(code: Column | str, permanent: Column) -> Column:
    """The error class of a process's exit code: none for 0, permanent for those listed, else transient."""
    return F.when(_col(code) == 0, F.lit(None).cast("string")).when(F.array_contains(permanent, _col(code)), "permanent").otherwise("transient")


def error_json(message: Column | str) -> Column:
    return F.to_json(F.struct(_col(message).alias("message")))


def bytes_text(n: Column | str) -> Column:
    """B, KiB, MiB or GiB with one decimal."""
    x = _col(n)
    scaled = lambda k, unit: F.concat(F.format_string("%.1f", x / F.lit(float(1 << k))), F.lit(f" {unit}"))
    return F.when(x >= 1 << 30, scaled(30, "GiB")).when(x >= 1 << 20, scaled(20, "MiB")).when(x >= 1 << 10, scaled(10, "KiB")).otherwise(F.concat(x.cast("string"), F.lit(" B")))


def thousands(n: Column | str) -> Column:
    return F.format_number(_col(n), 0)


def resident_bytes(statm: Column | str, page: int = 4096) -> Column:
    """The resident size of a /proc statm line; null where it has no second number."""
    return F.regexp_extract(_col(statm), r"^\d+ (\d+)", 1).try_cast("bigint") * page


def capped(raw: Column | str, most: int = OUTPUT_BYTES) -> Column:
    """The first `most` bytes."""
    return F.substring(_col(raw).cast("binary"), 1, most)


def error_count(text: Column | str) -> tuple[Column, Column]:
    """The message and the count of "message (×N)"; a text without the ending counts once."""
    found = F.regexp_extract(_col(text), r"(?s)^(.*) \(×(\d+)\)$", 2)
    return F.when(found != "", F.regexp_extract(_col(text), r"(?s)^(.*) \(×(\d+)\)$", 1)).otherwise(_col(text)), F.when(found != "", found.try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))


def fault_spec(text: Column | str) -> tuple[Column, Column, Column]:
    """name, fraction (0.5 if none is given) and duration text of name[@fraction][:duration]; a name of null where it fits not."""
    pattern = r"^([a-z][a-z-]*)(?:@(0(?:\.\d+)?|1(?:\.0+)?))?(?::([0-9a-z.]+))?$"
    fits = _col(text).rlike(pattern)
    part = lambda k: F.nullif(F.regexp_extract(_col(text), pattern, k), F.lit(""))
    return F.when(fits, part(1)), F.when(fits, F.coalesce(part(2).try_cast("double"), F.lit(0.5))), F.when(fits, part(3))


def valid_schema_name(name: Column | str) -> Column:
    return _col(name).rlike(r"^[a-z_][a-z0-9_]{0,62}$")


def redacted_dsn(dsn: Column | str) -> Column:
    """A connection string without its password; what is not understood is hidden whole."""
    t = _col(dsn)
    url = r"^([a-z][a-z0-9+]*://)([^:@/]*)(?::[^@]*)?@([^@]*)$"
    hidden = lambda x: F.regexp_replace(x, r"(?i)(password|sslpassword)=[^&\s]*", "$1=xxxxx")
    return (
        F.when(t == "", F.lit(""))
        .when(t.rlike(url), hidden(F.concat(F.regexp_extract(t, url, 1), F.regexp_extract(t, url, 2), F.when(t.rlike(r"://[^@/]*:[^@]*@"), F.lit(":xxxxx")).otherwise(F.lit("")), F.lit("@"), F.regexp_extract(t, url, 3))))
        .when(t.rlike(r"^[a-z][a-z0-9+]*://[^@]*$"), hidden(t))
        .when(t.rlike(r"^(?:[a-z_]+=[^\s']*\s*)+$"), hidden(t))
        .otherwise(F.lit("[redacted]"))
    )


def monotone_id(ms: Column | str, key: Column | str) -> Column:
    """An id of a time in ms and a hash of key, in the form of a UUID of version 7; ids ascend with the time."""
    a, b = F.lpad(F.lower(F.hex(_col(ms))), 12, "0"), F.lpad(F.lower(F.hex(F.xxhash64(_col(key)))), 16, "0")
    return F.concat(F.substring(a, 1, 8), F.lit("-"), F.substring(a, 9, 4), F.lit("-7"), F.substring(b, 1, 3), F.lit("-8"), F.substring(b, 4, 3), F.lit("-"), F.substring(F.lpad(F.lower(F.hex(F.xxhash64(_col(key), F.lit(1)))), 16, "0"), 1, 12))


def failing(ordinal: Column | str, seed: int, rate: float) -> Column:
    """Whether the job of an ordinal fails, at a rate, by the splitmix64 of seed and ordinal; exact whole arithmetic in Arrow batches."""
    def decide(ordinals: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            z = np.uint64(seed) + (ordinals.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return pa.array((z >> np.uint64(11)).astype(np.float64) / 2.0**53 < rate)

    return F.arrow_udf(decide, "boolean")(_col(ordinal).cast("bigint"))
