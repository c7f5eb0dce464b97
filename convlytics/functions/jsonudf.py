"""JSON checks that follow Python's rules, in the JVM where both parsers agree.

Spark's JSON parsers accept text after a document and reject duplicate keys and
NaN, where ``json.loads`` does the opposite.  :func:`agreed` proves for a text
that the two cannot differ: it is one document, made of tokens that Python
writes back as they stand, without a repeated key.  What such a text holds is
read by column expressions.  All other texts go to ``json.loads`` in one pandas
UDF, which gets NULL for the proven ones, so their bytes never leave the JVM.
No input ends a batch: what cannot be read is invalid, however deep it nests,
and lone surrogates come back as escapes.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convlytics.functions.text import extract_json_block

READ_TYPE = T.StructType([
    T.StructField("valid", T.BooleanType()),
    T.StructField("is_object", T.BooleanType()),
    T.StructField("keys", T.ArrayType(T.StringType())),
    # keys whose value is a list that is not empty
    T.StructField("lists", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()),
])


def _utf8(text: str) -> str:
    """Lone surrogates as JSON escapes: Arrow carries well-formed text only."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _describe(document: str | None) -> tuple:
    if document is None:
        return None, None, None, None, None
    try:
        value = json.loads(document)
        compact = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return False, False, [], [], None
    members = value if isinstance(value, dict) else {}
    lists = [_utf8(k) for k, v in members.items() if isinstance(v, list) and v]
    return True, isinstance(value, dict), [_utf8(k) for k in members], lists, _utf8(compact)


@F.pandas_udf(READ_TYPE)
def _python_read(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_describe(d) for d in documents], columns=READ_TYPE.fieldNames(), dtype=object)


# a string in the escapes that Python writes, and what else it writes back unchanged: whole
# numbers but -0, fractions of few enough digits to have no shorter spelling nor an exponent
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\["\\nrtbf][^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]{0,8})\.(?:0|[0-9]{0,3}[1-9])(?![0-9])|-?[1-9][0-9]*+|0"
#: possessive, so that Java matches texts of any length without recursion
_TOKENS = rf"\A(?:[ \t\r\n{{}}\[\]:,]|{_STRING}|true|false|null|{_NUMBER})*+\z"
_SPACE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]++'
#: closes the list that a text is read in; a text that holds it is not proven
_END = "end of the text \u2408"


def agreed(document: Column) -> Column:
    """Whether the JVM's reading of a text is certain to be Python's.

    The text is read as first element of a list whose second is ``_END``.  As
    the text does not hold ``_END``, finding it there means that the text
    neither closed the list nor held a second document.  Of a repeated key the
    JVM keeps one or refuses the text, as the session is set, so what was read
    then has fewer strings than the text.  False for NULL and in any doubt.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), document, F.lit(f',"{_END}"]')))
    second = F.try_variant_get(listed, "$[1]", "string")
    every = F.lit(_STRING)
    kept = F.regexp_count(F.to_json(listed), every) == F.regexp_count(document, every) + 1
    return F.coalesce(document.rlike(_TOKENS) & ~document.contains(_END) & (second == _END) & kept, F.lit(False))


def _compact(document: Column) -> Column:
    """A proven text without the white space outside its strings."""
    return F.regexp_replace(document, _SPACE, "$1")


def _native_read(document: Column) -> Column:
    """What a proven text holds, as READ_TYPE."""
    text = _compact(document)
    is_object = text.startswith("{")
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    values = F.when(is_object, F.try_variant_get(F.try_parse_json(document), "$", "map<string,variant>"))

    def is_list(key):
        shown = F.to_json(F.element_at(values, key))
        return shown.startswith("[") & (shown != "[]")

    lists = F.filter(keys, lambda k: F.coalesce(is_list(k), F.lit(False)))
    return F.struct(F.lit(True).alias("valid"), is_object.alias("is_object"), keys.alias("keys"),
                    lists.alias("lists"), text.alias("text"))


def _unproven(document: Column) -> Column:
    """The text where Python must read it, or else NULL."""
    return F.when(~agreed(document), document)


def read_document(document: Column) -> Column:
    """What a text holds, as READ_TYPE; NULL is not valid."""
    python = _python_read(_unproven(document))
    nothing = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return (F.when(document.isNull(), F.struct(F.lit(False).alias("valid"), F.lit(False).alias("is_object"),
                                               empty.alias("keys"), empty.alias("lists"), nothing.alias("text")))
            .when(python["valid"].isNotNull(), python).otherwise(_native_read(document)))


def inspect_answer(answer: Column) -> Column:
    """What an answer holds: its block from the first to the last brace, or else all of it."""
    return read_document(F.coalesce(extract_json_block(answer), answer))


def parse_json_lenient(answer: Column) -> Column:
    """Compact JSON of the whole text, or else of its block, or else ``{}``."""
    def reading(document):
        python = _python_read(_unproven(document))
        return F.when(document.isNotNull() & python["valid"].isNull(), _compact(document)).otherwise(python["text"])

    # a block that is the whole text needs no second reading
    block = F.when(extract_json_block(answer) != answer, extract_json_block(answer))
    return F.coalesce(reading(answer), reading(block), F.lit("{}"))


def is_strict_json(answer: Column) -> Column:
    """Whether the whole text is one JSON document."""
    python = _python_read(_unproven(answer))
    return answer.isNotNull() & F.coalesce(python["valid"], F.lit(True))
