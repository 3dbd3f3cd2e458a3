"""Names, paths and times of recordings as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoline.functions.constants import REPAIRED_AS

#: The fourth is how the ingest writes times.
_FORMATS = ("yyyyMMddHHmmss", "yyyy-MM-dd_HH-mm-ss", "yyyyMMdd_HHmmss", "yyyy-MM-dd_HH_mm_ss")


def parse_filename(name: Column) -> Column:
    """``sensor~recording~time~gain.wav`` as a struct of strings; null unless there are exactly four parts and ``.wav``."""
    parts = F.split(F.regexp_replace(name, r"(?i)\.wav$", ""), "~")
    fields = [parts[i].alias(n) for i, n in enumerate(("sensor_id", "recording_id", "timestamp", "gain_db"))]
    return F.when(name.rlike(r"(?i)\.wav$") & (F.size(parts) == 4), F.struct(*fields))


def viewer_gain(name: Column) -> Column:
    """The fourth of four parts or more as a number; null where there is none."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "~")
    return F.when(F.size(parts) >= 4, parts[3].try_cast("double"))


def parse_time(text: Column) -> Column:
    """The first of four formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _FORMATS]).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def drift_s(a: Column, b: Column) -> Column:
    """Seconds between two times; null if either is."""
    return F.abs(micros(a) - micros(b)) / 1e6


def event_time_label(text: Column) -> Column:
    """``2018-12-16 04:30:00`` as ``2018_12_16_04_30_00``; other texts with the separators replaced."""
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(parsed, "yyyy_MM_dd_HH_mm_ss"), F.translate(text, "-: ", "___"))


def sanitize_path(text: Column) -> Column:
    return F.regexp_replace(text, r'[<>:"/\\|?*\s]+', "_")


def sanitize_filename(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:"*?<>|]+', "_")


def site_tokens(text: Column) -> Column:
    """Four tokens, filled up with OFF; null-like tokens are OFF."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    padded = F.slice(F.concat(words, F.array_repeat(F.lit("OFF"), 4)), 1, 4)
    return F.transform(padded, lambda w: F.when(F.lower(w).isin("null", "none", "0"), F.lit("OFF")).otherwise(w))


def output_path(folder: Column, base: Column, kind: Column, time: Column, gain: Column) -> Column:
    """Where a download goes, by its format; a wav without time or gain is an error."""
    stem = F.concat_ws("/", folder, base)
    wav = F.when(time.isNull() | gain.isNull(), F.raise_error(F.lit("a wav needs time and gain"))).otherwise(
        F.concat(F.concat_ws("~", stem, sanitize_path(time), sanitize_path(gain)), F.lit(".wav"))
    )
    return (
        F.when(kind == "json", F.concat(stem, F.lit(".json"))).when(kind == "json_flot", F.concat(stem, F.lit(".flot.json")))
        .when(kind == "csv", F.concat(stem, F.lit(".csv"))).when(kind == "wav", wav).otherwise(stem)
    )


def repaired_as(text: Column) -> Column:
    table = F.create_map(*map(F.lit, chain(*REPAIRED_AS.items())))
    return F.coalesce(F.element_at(table, F.trim(F.coalesce(text, F.lit("")))), F.lit("unknown"))


def _number_or_zero(text: Column) -> Column:
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(clean.isin("", "-1"), F.lit("0")).otherwise(sanitize_filename(clean))


def standard_name(leak: Column, site: Column, recording: Column, when: Column, noise: Column, spread: Column, repaired: Column, part: Column, padded: Column) -> Column:
    """``leak~site~recording~time~100~noise~spread~repair[_partN][_padded].wav``."""
    status = F.when(F.lower(F.trim(F.coalesce(leak, F.lit("")))) == "yes", F.lit("leak")).otherwise(F.lit("noleak"))
    stem = F.concat_ws(
        "~", status, sanitize_filename(site), sanitize_filename(recording), sanitize_filename(event_time_label(F.coalesce(when, F.lit("")))),
        F.lit("100"), _number_or_zero(noise), _number_or_zero(spread), repaired_as(repaired),
    )
    return F.concat(
        stem, F.when(part.isNotNull(), F.concat(F.lit("_part"), part.cast("string"))).otherwise(F.lit("")),
        F.when(padded, F.lit("_padded")).otherwise(F.lit("")), F.lit(".wav"),
    )


def folder_label(text: Column) -> Column:
    return F.upper(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("-")))


def file_label(text: Column) -> Column:
    return F.upper(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("_")))


def _two_decimals(x: Column) -> Column:
    """``x`` with ties at the third decimal moved to the even side, as C and Python print them; Java rounds them up. Ties of binary numbers are odd eighths."""
    return F.when(F.abs(x * 8) % 2 == 1, F.bround(x * 100) / 100).otherwise(x)


def bytes_human(n: Column) -> Column:
    """Powers of 1024 with two decimals."""
    size, out = n.cast("double"), None
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.format_string(f"%.2f {unit}", _two_decimals(size / float(1024**i)))
        out = F.when(size < float(1024 ** (i + 1)), text) if out is None else out.when(size < float(1024 ** (i + 1)), text)
    return out.otherwise(F.format_string("%.2f PB", _two_decimals(size / float(1024**5))))
