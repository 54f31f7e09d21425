"""Labels, domains, splits, type codes, times and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the two classes.
POSITIVE = ("1", "pos", "positive", "broken_wire", "brokenwire", "bk", "defect", "fault", "断丝")
NEGATIVE = ("0", "neg", "negative", "noise", "normal", "flow_noise", "流噪声")
#: Time formats in order of trial.
TIME_FORMATS = ("yyyyMMdd'T'HHmmss.SSSSSS", "yyyyMMdd'T'HHmmss.SSS", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss.SSSSSS", "yyyyMMddHHmmss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")


def type_code(text: Column) -> Column:
    """Sum of (place + 1) times the character code of the trimmed capitals, modulo 10000."""
    t = F.upper(F.trim(text))
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    return (F.aggregate(F.transform(chars, lambda c, i: (i + 1).cast("long") * F.ascii(c)), F.lit(0).cast("long"), lambda s, x: s + x) % 10000).cast("int")


def normalize_label(c: Column) -> Column:
    """0 or 1, of a boolean, a number (cut to a whole one) or one of the spellings; anything else raises."""
    t = F.lower(F.trim(c.cast("string")))
    t = F.when(F.typeof(c) == "boolean", F.when(t == "true", "1").otherwise("0")).otherwise(t)
    n = t.try_cast("double").cast("int")
    return F.when(t.isin(*POSITIVE), 1).when(t.isin(*NEGATIVE), 0).when(n.isNotNull(), n).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(t, F.lit("null")))).cast("int"))


def base_domain(path: Column) -> Column:
    """File stem without split suffix and set prefix, in capitals."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"(?i)_(train|test|tr|te)$", "")
    return F.upper(F.regexp_replace(F.regexp_replace(stem, "(?i)^BK14_", ""), "(?i)^BK14-", ""))


def infer_split(explicit: Column, folder: Column) -> Column:
    """train or test from the column, else from the folder's suffix, else unknown."""
    e, f = F.lower(F.trim(explicit)), F.lower(F.trim(folder))
    return (
        F.when(e.isin("train", "tr", "training"), "train").when(e.isin("test", "te", "testing"), "test")
        .when(f.rlike("_(tr|train)$"), "train").when(f.rlike("_(te|test)$"), "test").otherwise("unknown")
    )


#: The classes, and spellings of them in the sources.
SOURCE_LABELS = ("FL00", "FL05", "BK00", "BK05", "QJ00", "QJ05")
SOURCE_ALIASES = {
    "FL00": ("fl00", "flow00", "v0-flow", "0829-flow-v0", "flow-v0"),
    "FL05": ("fl05", "flow05", "v0.5-flow", "v05-flow", "flow-v05", "flow-v0.5"),
    "BK00": ("bk", "bk00", "v0-bk"),
    "BK05": ("bk05", "v05-bk", "v0.5-bk"),
    "QJ00": ("qj", "qj00", "v0-qj"),
    "QJ05": ("qj05", "v05-qj", "v0.5-qj"),
}


def source_label(value: Column, fallback: Column) -> Column:
    """The class that a source's spelling means; the fallback (the folder's class) for a missing, general or unknown one."""
    t = F.lower(F.trim(value.cast("string")))
    found = F.coalesce(*[F.when(t.isin(*names), k) for k, names in SOURCE_ALIASES.items()])
    return F.coalesce(found, fallback)


def target_label(source: Column) -> Column:
    """BK or Other of a class; any other text is an error."""
    t = F.trim(source)
    known = F.when(t.isin(*SOURCE_LABELS), F.when(t.startswith("BK"), "BK").otherwise("Other"))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no class: "), F.coalesce(t, F.lit("null")))).cast("string"))


def binary_label(label: Column) -> Column:
    return F.upper(label).startswith("BK").cast("int")


def flow_condition(label: Column) -> Column:
    return F.when(label.endswith("00"), "00").when(label.endswith("05"), "05").otherwise("unknown")


def signal_family(label: Column) -> Column:
    p = F.upper(F.substring(label, 1, 2))
    return F.when(p.isin("BK", "FL", "QJ"), p).otherwise("OTHER")


def source_stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"\.[^.]*$", "")


def parse_time(text: Column) -> Column:
    """The first format that fits; NULL if none."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS])


def format_time(ts: Column) -> Column:
    """Compact text, milliseconds cut off."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss.SSS")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.rint(seconds * 1e6).cast("long"))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def points_per_frame(name: Column) -> Column:
    return F.regexp_extract(name, r"-(\d+)pt-", 1).try_cast("int")


def rate_from_name(name: Column) -> Column:
    """Hz from `-<n>Hz-`, `-FIP-<n>K-` or a token `<n>k|M[Hz]`."""
    hz = F.regexp_extract(name, r"-(\d+)Hz-", 1).try_cast("double")
    fip = F.regexp_extract(name, r"-FIP-(\d+)K-", 1).try_cast("double") * 1e3
    number = F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)\s*([km])(?:hz)?(?![a-z])", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(name, r"(?i)(\d+(?:\.\d+)?)\s*([km])(?:hz)?(?![a-z])", 2))
    return F.coalesce(hz, fip, number * F.when(unit == "m", 1e6).otherwise(1e3))


def first_property(properties: Column, *names: str) -> Column:
    """The first of the names that the map holds, whatever its case."""
    lower = F.transform_keys(properties, lambda k, _: F.lower(k))
    return F.coalesce(*[F.try_element_at(lower, F.lit(n.lower())) for n in names])


def output_name(stem: Column, rate_khz: int, w1: Column, w2: Column, shift: Column, suffix: Column) -> Column:
    """<stem with its first rate token replaced>-w1_w2_t-suffix.npz"""
    renamed = F.regexp_replace(stem, r"^(.*?)-\d+K-", f"$1-{rate_khz}K-")
    # format_string, not format_number, which would put commas in
    return F.format_string("%s-%.2f_%.2f_%.3f-%s.npz", renamed, w1.cast("double"), w2.cast("double"), shift.cast("double"), suffix)


def split_feature(name: Column) -> tuple[Column, Column]:
    """band__feature -> (band, feature); a name without a band has the empty one."""
    parts = F.split(name, "__", 2)
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit("")), F.element_at(parts, -1)
