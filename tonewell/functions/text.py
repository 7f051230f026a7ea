"""Attribute cleaning and text functions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewell.functions.hashing import sha256_mod, uniform

# Fixed value: the characters Python counts as white space.
PY_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a regex class.
PY_SPACE = f"[{PY_SPACES}]"
# Fixed value: punctuation tokens left out of the hashed vocabulary.
PUNCTUATION = ("?", ":", "!", ".", ",", ";")
# Texts folded to ASCII at a time.
FOLD_ROWS = 100
# Fixed value: order of the structured prompt fields.
PROMPT_FIELDS = (
    "description",
    "general_mood",
    "genre_tags",
    "lead_instrument",
    "accompaniment",
    "tempo_and_rhythm",
    "vocal_presence",
    "production_quality",
)
# Fixed value: fields merged into a description, in record order.
MERGED_FIELDS = (
    "key",
    "bpm",
    "genre",
    "moods",
    "keywords",
    "instrument",
    "general_mood",
    "genre_tags",
    "lead_instrument",
    "accompaniment",
    "tempo_and_rhythm",
    "vocal_presence",
    "production_quality",
)


def strip(c: Column) -> Column:
    """Trim every character Python's ``str.strip`` trims."""
    return F.btrim(c, F.lit(PY_SPACES))


def _is_null_text(c: Column) -> Column:
    return c.isNull() | (c == "") | (c == "None")


def get_string(c: Column) -> Column:
    return F.when(~_is_null_text(c), strip(c))


def get_keyword(c: Column) -> Column:
    return F.lower(get_string(c))


def _keywords(values: Column) -> Column:
    kept = F.filter(F.transform(values, get_keyword), lambda k: k.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def get_keyword_list(c: Column, kind: str = "string") -> Column:
    """Keyword array of a string (split on comma or space), array or number column."""
    if kind == "array":
        return _keywords(c)
    if kind == "number":
        # A missing number reads as the word "none"; NaN is an empty list.
        word = F.when(c.isNull(), F.lit("none")).otherwise(c.cast("string"))
        return F.when(~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0))), F.array(word))
    # The split leaves no white space to strip in a word.
    words = F.filter(F.split(c, f"[,{PY_SPACE[1:]}"), lambda w: (w != "") & (w != "None"))
    return F.when(F.size(words) > 0, F.transform(words, F.lower))


def get_musical_key(c: Column) -> Column:
    word = get_keyword(c)
    return F.when(~word.contains(","), word)


#: What counts as a number: digits with single underscores, a fraction, an exponent, or a name.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def get_bpm(c: Column) -> Column:
    """Number of a string; null for anything else, also for a number with a type suffix."""
    plain = strip(c)
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def normalise_text(c: Column, default: str = "Unknown") -> Column:
    trimmed = strip(c)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(default))


def struct_to_text(columns: dict[str, Column]) -> Column:
    """``name: value`` pairs in the fixed prompt order; array columns are joined by ", "."""
    parts = []
    for name in PROMPT_FIELDS:
        if name in columns:
            value = strip(columns[name])
            parts.append(F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(". ", *parts)


def mix_text(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" "), b))


def merge_description(
    description: Column,
    fields: dict[str, Column],
    row_key: Column,
    merge_p: float,
    drop_description_p: float,
    keep_other_p: float,
    seed: int = 0,
) -> Column:
    """Description extended by shuffled ``name: value`` pairs.

    ``keep_other_p`` is the probability that a field is kept. A kept description
    loses its trailing dots and always gets ". " before the (maybe empty) pairs.
    """
    pairs = F.array(
        *[
            F.struct(
                uniform(f"{seed}:order:{name}", row_key).alias("u"),
                F.lit(name).alias("name"),
                F.when(
                    fields[name].isNotNull()
                    & (uniform(f"{seed}:keep:{name}", row_key) < F.lit(keep_other_p)),
                    F.concat(F.lit(f"{name}: "), fields[name].cast("string")),
                ).alias("pair"),
            )
            for name in MERGED_FIELDS
            if name in fields
        ]
    )
    pairs = pairs.cast("array<struct<u: double, name: string, pair: string>>")
    kept = F.array_sort(F.filter(pairs, lambda p: p["pair"].isNotNull()))
    merging = uniform(f"{seed}:merge", row_key) < F.lit(merge_p)
    metadata = F.when(merging, F.array_join(F.transform(kept, lambda p: p["pair"]), ". ")).otherwise("")
    dropped = merging & (uniform(f"{seed}:drop", row_key) < F.lit(drop_description_p))
    base = F.when(~dropped, description)
    merged = F.when(
        base.isNull(), F.when(F.length(metadata) > 1, metadata)
    ).otherwise(F.concat(F.rtrim(base, F.lit(".")), F.lit(". "), metadata))
    return F.when(F.length(merged) > 0, strip(merged))


def word_dropout(c: Column, p: float, seed, *keys) -> Column:
    """Drop each space-separated word with probability p."""
    words = F.transform(F.split(c, " ", -1), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(words, lambda x: uniform(seed, *keys, x["i"]) >= F.lit(p))
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def hash_tokens(c: Column, bins: int, pad: int = 0) -> Column:
    """Bucket per white-space token; a null text is one pad value of length 0."""
    tokens = F.filter(
        F.split(strip(c), f"{PY_SPACE}+"), lambda w: (w != "") & ~w.isin(*PUNCTUATION)
    )
    hashed = F.transform(tokens, lambda w: sha256_mod(w, bins))
    return F.struct(
        F.coalesce(hashed, F.array(F.lit(pad).cast("bigint"))).alias("tokens"),
        F.coalesce(F.size(tokens), F.lit(0)).alias("length"),
    )


def hash_label(c: Column, bins: int, pad: int = 0) -> Column:
    """One bucket for the whole label, with mask 0 for null."""
    return F.struct(
        F.coalesce(sha256_mod(c, bins), F.lit(pad).cast("bigint")).alias("token"),
        c.isNotNull().cast("int").alias("mask"),
    )


def _folded(v: str | None) -> str | None:
    return None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")


@F.arrow_udf(T.StringType())
def _fold_batch(values: pa.Array) -> pa.Array:
    # Texts take several times their bytes as Python objects: only a slice of the batch is that at once.
    slices = (values.slice(i, FOLD_ROWS) for i in range(0, len(values), FOLD_ROWS))
    folded = [pa.array(map(_folded, s.to_pylist()), pa.string()) for s in slices]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(folded) if folded else pa.array([], pa.string())


def _ascii_fold(c: Column) -> Column:
    """Decomposed text without what is not ASCII; texts in ASCII stay as they are and are not sent to Python."""
    return F.coalesce(_fold_batch(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def slugify(c: Column) -> Column:
    """File-name form of a text: ascii, lower case, words joined by single dashes."""
    # After the ASCII fold these are the only white-space characters left.
    blank = "\t\n\x0b\x0c\r\x1c-\x1f "
    kept = F.regexp_replace(F.lower(_ascii_fold(c)), f"[^a-z0-9_{blank}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, f"[{blank}-]+", "-"), "^[-_]+|[-_]+$", "")


def reference_id(digest: Column, sample: Column, reuse: bool) -> Column:
    """Identifier of a prompt or reference: that of the sample, or the digest of its own samples."""
    return F.when(digest.isNotNull(), sample if reuse else digest)


@F.pandas_udf(T.StringType())
def sorted_json(maps: pd.Series) -> pd.Series:
    """JSON text of a string map, keys sorted, ``", "`` and ``": "`` separators, ASCII escapes."""
    return maps.map(lambda m: None if m is None else json.dumps(dict(m), sort_keys=True))


def sample_id(index: Column, prompt: Column, conditions: Column, reuse_uuid: Column | None = None) -> Column:
    """Identifier of a generated sample.

    sha1 over index, raw prompt bytes and the sorted JSON of the conditions, then
    a readable label; rows without any input get a random ``noinput_`` name.
    """
    has_conditions = conditions.isNotNull() & (F.size(conditions) > 0)
    digest = F.sha1(
        F.concat(
            F.encode(index.cast("string"), "UTF-8"),
            F.coalesce(prompt, F.lit(b"")),
            F.encode(F.when(has_conditions, sorted_json(conditions)).otherwise(""), "UTF-8"),
        )
    )
    pairs = F.transform(
        F.array_sort(F.map_entries(slug_values(conditions))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    label = F.substring(F.array_join(pairs, "-"), 1, 100)
    readable = F.concat(
        F.when(prompt.isNotNull(), F.lit("_prompted")).otherwise("_unprompted"),
        F.when(has_conditions & (F.length(label) > 0), F.concat(F.lit("_"), label)).otherwise(
            "_unconditioned"
        ),
    )
    random_name = reuse_uuid if reuse_uuid is not None else F.regexp_replace(F.uuid(), "-", "")
    return F.when(
        prompt.isNull() & ~has_conditions, F.concat(F.lit("noinput_"), random_name)
    ).otherwise(F.concat(digest, readable))


def slug_values(conditions: Column) -> Column:
    """Condition map with slugified values, the form used in readable labels.

    The fold to ASCII runs over one joined text per row, so a row costs one
    vectorised call whatever the number of conditions.
    """
    keys, mark = F.map_keys(conditions), "\x01"
    joined = _ascii_fold(F.array_join(F.map_values(conditions), mark))
    blank = "\t\n\x0b\x0c\r\x1c-\x1f "

    def clean(v):
        kept = F.regexp_replace(F.lower(v), f"[^a-z0-9_{blank}-]", "")
        return F.regexp_replace(F.regexp_replace(kept, f"[{blank}-]+", "-"), "^[-_]+|[-_]+$", "")

    return F.map_from_arrays(keys, F.transform(F.split(joined, mark, -1), clean))


def apply_mappers(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regex rewrites."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def resolve_reference(c: Column, folder: str) -> Column:
    """Replace a leading ``//reference`` by the reference folder."""
    return F.regexp_replace(c, "^//reference", folder.replace("\\", "\\\\").replace("$", "\\$"))


def parse_zip_path(c: Column) -> Column:
    """``zip:inner`` as a struct; anything but one colon is an error."""
    parts = F.split(c, ":")
    checked = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("not a zip path: "), c)).cast("array<string>")
    )
    return F.when(
        c.isNotNull(), F.struct(checked[0].alias("zip_path"), checked[1].alias("file_path"))
    )


def set_signature(names: Column) -> Column:
    """First ten hex digits of the sha1 of the JSON list of names (ASCII names)."""
    quoted = F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    return F.substring(F.sha1(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))), 1, 10)


def pick_element(values: Column, seed, *keys) -> Column:
    """One random element of a list; null for an empty one."""
    at = F.floor(uniform(seed, *keys) * F.size(values)).cast("int")
    return F.get(values, at)


def absolute_path(c: Column, base: str) -> Column:
    """Relative paths get the base folder; for ``zip:inner`` only the zip part counts."""
    return F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def file_stem(c: Column) -> Column:
    """File name without folder and last suffix."""
    name = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def track_name(c: Column) -> Column:
    """File name up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(c, "/"), -1), "\\."), 1)


