"""Text expressions: Unicode-aware strip/split, chunking, hashing, JSON cut-out.

All helpers return ``Column`` expressions so they stay inside whole-stage
codegen; none of them runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.split()`` / ``str.strip()``
# written as a Java regex class: Java \s (space, \t \n \x0B \f \r), the file/
# group/record/unit separators U+001C..U+001F, NEL U+0085, and every Unicode
# separator (category Z: Zs, Zl, Zp).  U+200B is not whitespace in Python.
WS_CLASS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"

# Reference sizes for training text and chunking.
MAX_CHARS = 1000
CHUNK_WORDS = 500


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ustrip(col) -> Column:
    """``str.strip()`` with Python's Unicode whitespace set."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def words(col) -> Column:
    """``str.split()``: split on Unicode whitespace runs, no empty tokens."""
    parts = F.split(_c(col), f"{WS_CLASS}+")
    return F.filter(parts, lambda w: w != F.lit(""))


def chunk_word_array(words_col, chunk_size: int = CHUNK_WORDS) -> Column:
    """Chunks (at most ``chunk_size`` words joined by one space) of a word array column.

    Pass a column reference, not an expression: the lambda reads it once per
    chunk, and Spark does not share subexpressions inside lambdas.
    """
    w = _c(words_col)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(chunk_size))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice(w, i, chunk_size), " "))
    return F.when(F.size(w) > 0, chunks).otherwise(F.array().cast("array<string>"))


def chunk_words(col, chunk_size: int = CHUNK_WORDS) -> Column:
    """Array of chunks of at most ``chunk_size`` words joined by one space.

    Empty / NULL text gives an empty array (zero chunks).  For large texts
    prefer projecting :func:`words` first and calling :func:`chunk_word_array`.
    """
    return chunk_word_array(words(F.coalesce(_c(col), F.lit(""))), chunk_size)


def sha256_hex(col) -> Column:
    """SHA-256 hex digest of the UTF-8 bytes."""
    return F.sha2(_c(col), 256)


def prepare_training_text(col, max_chars: int | None = MAX_CHARS) -> Column:
    """NULL -> '', Unicode strip, first ``max_chars`` code points (None: all)."""
    text = ustrip(F.coalesce(_c(col), F.lit("")))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def extract_json_block(col) -> Column:
    """Text from the first '{' to the last '}' (greedy, across lines); NULL if none."""
    m = F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)
    return F.when(m == F.lit(""), F.lit(None).cast("string")).otherwise(m)


def python_float(col) -> Column:
    """A double as Python spells it: '13.0', '12345678.9', '0.0001', '1e+20', 'nan', 'inf'.

    Java turns to an exponent outside 1e-3 to 1e7, Python outside 1e-4 to 1e16;
    only what Java writes with an exponent is spelled anew.
    """
    java = _c(col).cast("double").cast("string")
    part = lambda i: F.regexp_extract(java, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i)
    sign, tail, e = part(1), F.regexp_replace(part(3), "^0$", ""), F.nullif(part(4), F.lit("")).cast("int")
    digits = F.concat(part(2), tail)
    whole = F.rpad(digits, F.greatest(e + 1, F.char_length(digits)), "0")
    large = F.concat(sign, F.substr(whole, F.lit(1), e + 1), F.lit("."),
                     F.coalesce(F.nullif(F.substr(whole, e + 2), F.lit("")), F.lit("0")))
    power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(e).cast("string"))), "0"))
    spread = F.concat(sign, part(2), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), power)
    return (F.when(java == "NaN", "nan").when(java == "Infinity", "inf").when(java == "-Infinity", "-inf")
            .when(e.isNull(), java).when(e.between(0, 15), large).when(e == -4, F.concat(sign, F.lit("0.000"), digits))
            .otherwise(spread))


def _variant_scalar_text(v: Column) -> Column:
    """Text of a scalar VARIANT; fractional numbers print as Python floats ('13.0')."""
    kind = F.schema_of_variant(v)
    is_fraction = kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
    return F.when(is_fraction, python_float(F.try_variant_get(v, "$", "double"))).otherwise(
        F.try_variant_get(v, "$", "string")
    )


def normalize_content(col, dtype: str, raw: str | None = None) -> Column:
    """Flatten one message ``content`` value to clean text.

    ``dtype`` is the column's simple type string.  VARIANT values: null -> '',
    arrays -> elements joined by '; ' (scalars by their JSON text, strings
    unquoted), objects -> compact JSON, scalars -> stripped text.  A VARIANT
    holds its keys sorted; ``raw`` names a column with the value's own JSON
    text, whose key order is then kept.  Plain strings are stripped; other
    scalar types are cast to string and stripped, floating numbers as Python
    spells them, NaN counting as missing.
    """
    c = _c(col)
    if dtype == "variant":
        kind = F.schema_of_variant(c)
        elems = F.transform(
            F.try_variant_get(c, "$", "array<variant>"),
            lambda e: F.coalesce(_variant_scalar_text(e), F.to_json(e)),
        )
        return (
            F.when(c.isNull() | (kind == F.lit("VOID")), F.lit(""))
            .when(kind.startswith("ARRAY"), F.array_join(elems, "; "))
            .when(kind.startswith("OBJECT"), F.to_json(c) if raw is None else F.coalesce(F.col(raw), F.to_json(c)))
            .otherwise(ustrip(F.coalesce(_variant_scalar_text(c), F.lit(""))))
        )
    if dtype in ("array<double>", "array<float>"):
        return F.coalesce(F.array_join(F.transform(c, python_float), "; "), F.lit(""))
    if dtype.startswith("array"):
        return F.coalesce(F.array_join(F.transform(c, lambda e: e.cast("string")), "; "), F.lit(""))
    if dtype in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "").otherwise(python_float(c))
    if dtype.startswith("struct") or dtype.startswith("map"):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(ustrip(c.cast("string")), F.lit(""))
