"""File, chunk, run and class names as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = r"^(.+?)((?:__ms_[0-9]+_[0-9]+)+)$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def loose_stem(path: Column) -> Column:
    """What stands before the last dot, folders included; empty without a dot."""
    return F.regexp_extract(path, r"^(.*)\.[^.]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def parse_chunk(name: Column) -> tuple[Column, Column, Column]:
    """Base name, start and end (ms) of a chunk: all trailing suffixes are cut off, the leftmost gives the times (null without one)."""
    name = F.regexp_replace(name, r"\.(npy|wav)$", "")
    suffix = F.regexp_extract(name, CHUNK, 2)
    base = F.when(suffix != "", F.regexp_extract(name, CHUNK, 1)).otherwise(name)
    at = [F.when(suffix != "", F.regexp_extract(suffix, r"^__ms_([0-9]+)_([0-9]+)", k)).cast("bigint") for k in (1, 2)]
    return base, at[0], at[1]


def build_chunk(base: Column, start: Column, end: Column, offset: Column | None = None) -> Column:
    off = F.coalesce(offset, F.lit(0)) if offset is not None else F.lit(0)
    return F.concat(base, F.lit("__ms_"), (start + off).cast("bigint").cast("string"), F.lit("_"), (end + off).cast("bigint").cast("string"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def sanitized(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def canonical(name: Column, marker: str = "XC") -> Column:
    """The name from the marker on; as it is without one."""
    found = F.regexp_extract(name, f"({marker}.*)$", 1)
    return F.when(found != "", found).otherwise(name)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def lenient_double(x: Column) -> Column:
    return blank_to_null(x).try_cast("double")


def lenient_int(x: Column) -> Column:
    return blank_to_null(x).try_cast("double").cast("int")


def lora_rank(run_name: Column) -> Column:
    return F.nullif(F.regexp_extract(run_name, r"_r([0-9]+)_lr", 1), F.lit("")).cast("int")


def probe_mode(run_name: Column, rank: Column) -> Column:
    """lora with a positive rank; else by what the name holds; else unknown."""
    name = F.lower(run_name)
    return F.when(rank > 0, "lora").when(name.contains("lora"), "lora").when(name.contains("linear"), "linear").when(name.contains("finetune"), "finetune").otherwise("unknown")


def train_seconds(text: Column) -> tuple[Column, Column]:
    """Whether the training time is MAX, and its seconds ('p' is a decimal point); sort by both. Blank and unreadable: null."""
    t = F.upper(F.trim(text))
    return t == "MAX", F.when(t != "MAX", F.regexp_replace(t, "P", ".").try_cast("double"))


def frozen_layers(last: Column, layers: int) -> Column:
    """'none', 'all' or the comma-joined layers up to the last frozen one; negative ones count from the end."""
    k = F.when(last < 0, last + layers).otherwise(last)
    k = F.least(k, F.lit(layers - 1))
    return F.when(last.isNull(), "unknown").when(k < 0, "none").when(k == layers - 1, "all").otherwise(F.array_join(F.sequence(F.lit(0), F.greatest(k, F.lit(0))).cast("array<string>"), ","))


def hash_int(key: Column) -> Column:
    """The first eight hex digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint")


def shuffled(seed: int, *key: Column) -> Column:
    """A sort key that puts rows in a reproducible random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def drawn(share: float, seed: int, *key: Column) -> Column:
    """Whether a row is among a share of rows, by shuffled(): whether its first 32 bits, as a number, are below share * 2^32. Hexadecimal digits stand in the order of their values, so the text is compared."""
    least = math.ceil(share * 2**32)
    return shuffled(seed, *key) < f"{least:08x}" if 0 < least < 2**32 else F.lit(least > 0)


#: Species by name, with how they are shown.
SPECIES = {"Canary": "Canary", "Zebra_Finch": "Zebra Finch", "Bengalese_Finch": "Bengalese Finch"}


def canonical_species(text: Column) -> Column:
    """A species' name, in whatever case, with spaces or underscores; null if it is none."""
    known = F.create_map(*(F.lit(x) for name in SPECIES for x in (name.lower(), name)))
    return F.try_element_at(known, F.lower(F.replace(F.trim(text), F.lit(" "), F.lit("_"))))


def shown_species(text: Column) -> Column:
    return F.replace(canonical_species(text), F.lit("_"), F.lit(" "))


def train_folder(path: Column, noted: Column | None = None) -> tuple[Column, Column]:
    """The bird and the seconds of a folder of training files, as texts; empty where the path doesn't tell.

    The bird is the folder after 'classify', else after 'unit_detect'; 'all' below 'detect'; else the folder
    that holds 'train', 'test' or 'val'. Seconds are in the last folder's name (train_2p5s), else as noted.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    after = lambda word: F.get(parts, F.array_position(parts, F.lit(word)).cast("int"))
    has = lambda word: F.array_contains(parts, word)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    holder = F.when(last.isin("train", "test", "val"), F.try_element_at(parts, F.lit(-2)))
    bird = F.when(has("classify"), after("classify")).when(has("unit_detect"), after("unit_detect")).when(has("detect"), "all")
    seconds = F.replace(F.regexp_extract(last, "^train_(.+)s$", 1), F.lit("p"), F.lit("."))
    told = F.lit("") if noted is None else F.coalesce(F.regexp_replace(noted, r"^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(bird, holder, F.lit("")), F.when(F.coalesce(seconds, F.lit("")) == "", told).otherwise(seconds)


def general(x: Column, digits: int = 6) -> Column:
    """A number as C's %g writes it: so many significant digits, no trailing zeros, with an exponent below 1e-4 and from 10^digits on. What is rounded is the binary number itself, halves to even; Java's formats round its shortest decimal digits, halves up."""
    form = f"%.{digits}g"

    @F.arrow_udf("string")
    def text(numbers: pa.Array) -> pa.Array:
        return pa.array([None if n is None else form % n for n in numbers.to_pylist()], pa.string())

    return text(x.cast("double"))
