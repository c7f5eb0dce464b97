"""The JVM's reading of JSON against Python's: proven texts agree, all others go to Python."""

import json
import random

from pyspark.sql import functions as F

from convlytics.functions.jsonudf import agreed, inspect_answer, is_strict_json, parse_json_lenient, read_document

CASES = [
    '{}', '[]', '{"a":1}', ' {"a": [1, 2] , "b": [] }\n', '{"a":1}{"b":2}', '{"a":1} x', '{"a":1},{"b":2}', '{}],[{}',
    '{},7],[{}', '{"a":1,"a":2}', '{"a":{"b":1,"b":[2]}}', 'NaN', '{"a":NaN}', '{"a":Infinity}', '-0', '-0.0', '0.0',
    '1.50', '1e5', '01', '1.', '.5', '+1', '0.00001', '0.0001', '0.0012', '123456789012.5', '12345678901234567812.5',
    '1.5555555555555555', '9' * 30, '9' * 1200, '9' * 5000, '"a\\/b"', '"\\u00e9"', '"\\ud800"', '"é\\n\\t\\"\\\\ x"',
    '"a\tb"', '"a\u0001b"', '"\x7f "', '"open', '[1,2', '[1,]', '{"a":}', '{a:1}', "{'a':1}", 'true', 'null',
    'nul', '', ' ', '﻿{}', ' {}', '[' * 900 + ']' * 900, '[' * 3000 + ']' * 3000,
    '{"a":[null],"b":[[]],"c":"[1]","d":{"e":[1]},"":[0]}', '{"a.b":[1],"c d":[2],"$":[3],"k\'":[4],"[0]":[5]}',
    'say {"a": 1} now', 'a {"b":1} {"c":2}', '{"x":"' + 'y\\n' * 60000 + '"}', '{"t":"' + 'z' * 200000 + '"}',
    '["end of the text ␈"]', '1,"end of the text ␈"],[2', '{"a": [1], "b": {"c": {"a": []}}, "d": [[1]]}',
    '[{"a":1},{"a":2}]', '{"a":/*c*/1}', '{"A":1,"a":[2]}', None,
]


def expected(text):
    if text is None:
        return False, False, [], [], None
    try:
        value = json.loads(text)
        compact = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return False, False, [], [], None
    d = value if isinstance(value, dict) else {}
    clean = lambda x: x.encode("utf-8", "backslashreplace").decode()
    return (True, isinstance(value, dict), [clean(k) for k in d],
            [clean(k) for k, v in d.items() if isinstance(v, list) and v], clean(compact))


def fuzz(n, seed=5):
    r = random.Random(seed)
    parts = ['{', '}', '[', ']', ':', ',', ' ', '\n', '"a"', '"b"', '"a\\n"', '"\\u0041"', '1', '0', '-', '.5', '2.5',
             'e3', 'true', 'null', 'NaN', '"', '\\', 'é', '"a":', '"c":[', '{"d":']

    def value(depth):
        k = r.randrange(8 if depth else 6)
        if k < 6:
            return r.choice(['1', '-7', '2.25', '0', '-0', '1e3', 'true', 'null', '"x"', '"é\\t"', '"\\u00e9"', '3.10'])
        space = r.choice(['', ' ', '\n\t'])
        if k == 6:
            return '[' + space + (',' + space).join(value(depth - 1) for _ in range(r.randrange(4))) + ']'
        return '{' + (space + ',').join(f'"{r.choice("abcdefgh")}"{space}:{value(depth - 1)}'
                                        for _ in range(r.randrange(4))) + space + '}'

    for i in range(n):
        if i % 2:
            yield ''.join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        else:
            v = r.choice('[{') and '{"k":' + value(3) + ',"l":' + value(2) + '}'
            yield v + r.choice(['', '', '', ' ', '{}', ',1', '],[2', '}'])


def test_readings_equal_python(spark):
    texts = CASES + list(fuzz(4000))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", agreed(F.col("t")).alias("sure"), read_document(F.col("t")).alias("r"),
                     is_strict_json(F.col("t")).alias("strict"), inspect_answer(F.col("t")).alias("seen"),
                     parse_json_lenient(F.col("t")).alias("lenient")).collect()
    assert len(rows) == len(texts)
    sure = 0
    for row in rows:
        text = texts[row.i]
        want = expected(text)
        assert tuple(row.r) == want, text and text[:200]
        assert row.strict == want[0]
        assert not row.sure or want[0]
        sure += row.sure
        cut = text is not None and "{" in text and "}" in text and text.rfind("}") > text.find("{")
        block = text[text.find("{"):text.rfind("}") + 1] if cut else None
        assert tuple(row.seen) == expected(block if cut else text)
        assert row.lenient == (want[4] or (expected(block)[4] if cut else None) or "{}")
    valid = sum(expected(t)[0] for t in texts)
    assert sure > valid / 4


def test_proven_texts_stay_in_the_jvm(spark):
    """Python is handed NULL for a proven text, so ordinary answers cost it nothing."""
    from convlytics.functions.jsonudf import _unproven

    plain = ['{"route": "tecnico", "sentiment": "neutral", "motivo": "pregunta", "rationale": "n/a", "n": [1, 2.5]}',
             '[true, null, {"a": {"b": "c\\nd"}}]']
    odd = ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1} and more']
    df = spark.createDataFrame([(t,) for t in plain + odd], "t string")
    assert [r.u for r in df.select(_unproven(F.col("t")).alias("u")).collect()] == [None, None, *odd]
