"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. Base rules find e-mail addresses, IP addresses, payment cards (Luhn) and
   international phone numbers, leftmost first, per kind.
2. High-recall generators propose further spans, which may overlap: addresses
   with written-out signs, and numbers in groups.
3. Boosted trees judge each candidate by its format and its context.  They are
   fitted on a bounded sample of the candidates of all documents, chosen by hash
   for each kind and label and weighted by the share of them it stands for: one
   that overlaps a base span of its kind is a positive example, any other a
   negative one.
   Features say nothing of the signs that the base rules ask for, so what the
   trees learn carries over to spans that miss them.
4. Per kind, the threshold is the smallest score at which the held-back examples
   of all documents, a quarter, keep a precision of 0.95 (unmarked
   examples hold some that only lack the base rules' signs).  Candidates above it that touch no base span are
   added; base spans always stay.

The fitted trees become one SQL expression over the candidate's fields, so
scoring is a projection: no shuffle, no Python.  All positions are code points.

Defined results: null text counts as empty and has no spans; a null doc_id
stays null; repeated rows give repeated results.  Without examples of both
classes nothing is added to the base spans.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: candidates that the trees are fitted on, about
SAMPLE_CANDIDATES = 20_000
TREES, DEPTH = 12, 3
PRECISION = 0.95
#: held-back positive examples that a threshold rests on at least
EXAMPLES = 20

# Look-behinds only spare starts inside a run of the same characters, which
# could not match; \G lets a match start where the one before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: a text without this cannot match
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){0,8}",
    # a number without its country sign lies within the one that has it
    "local": r"(?<![0-9A-Za-z(])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])\(?[0-9][0-9 ().-]{5,28}[0-9](?![0-9A-Za-z])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLOCK = 256
MATCHES = "array<struct<start:int,stop:int,body:string,before:string,after:string>>"


def matches(text: Column, pattern: str, need: str | None) -> Column:
    """All matches as (start, stop, body, before, after), in text order."""
    none = F.array().cast(MATCHES)
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(bodies, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
                       lambda b, p: F.struct(b.alias("body"), p.alias("before")))
    steps = F.zip_with(steps, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                       lambda s, p: F.struct(s["body"].alias("body"), s["before"].alias("before"), p.alias("after")))
    size = lambda s: F.char_length(s["before"]) + F.char_length(s["body"])
    block = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), F.floor((F.size(bodies) - 1) / BLOCK).cast("int"))
    offsets = F.aggregate(
        blocks, F.array(F.lit(0)),
        lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(block(b), F.lit(0), lambda n, s: n + size(s)))))

    def walk(b, at):
        return F.aggregate(
            block(b), F.struct(at.alias("at"), none.alias("found")),
            lambda acc, s: F.struct(
                (acc["at"] + size(s)).alias("at"),
                F.concat(acc["found"], F.array(F.struct(
                    (acc["at"] + F.char_length(s["before"])).alias("start"), (acc["at"] + size(s)).alias("stop"),
                    s["body"].alias("body"), F.substring(s["before"], -30, 30).alias("before"),
                    F.substring(s["after"], 1, 10).alias("after")))).alias("found")),
            lambda acc: acc["found"])

    # positions are sums over what came before, taken block by block: an array
    # that grows match by match would be copied as often
    walked = F.when(F.size(bodies) > 0, F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)), walk)))
    some = text.rlike(pattern) if need is None else text.contains(need)
    return F.coalesce(F.when(some, walked), none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    d = F.reverse(_digits(body))
    value = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0),
                        lambda s, i: s + F.when(i % 2 == 0, doubled(i)).otherwise(value(i)))
    return total % 10 == 0


RULES = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m["body"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
    "card": lambda m: _luhn(m["body"]),
    "phone": lambda m: F.char_length(_digits(m["body"])).between(10, 15),
}


def _ranked(rank: int, kind: str) -> Column:
    """The matches of a kind that keep its rule, as spans."""
    return F.transform(F.filter(f"__{kind}", RULES[kind]), lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the base spans as (start, rank, kind, stop), in order."""
    for kind in KINDS:
        docs = docs.withColumn(f"__{kind}", matches(F.col("text"), BASE[kind], NEEDS[kind]))
    found = [_ranked(rank, kind) for rank, kind in enumerate(KINDS)]
    return docs.withColumn("base", F.array_sort(F.concat(*found))).drop(*[f"__{k}" for k in KINDS])


def _count(c: Column, chars: str) -> Column:
    return F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{chars}]", ""))


def _says(m: Column, words: str) -> Column:
    return m["before"].rlike(rf"(?i)\b(?:{words})").cast("int")


FEATURES = {
    "length": lambda m: F.char_length(m["body"]),
    "digits": lambda m: _count(m["body"], "0-9"),
    "letters": lambda m: _count(m["body"], "A-Za-z"),
    "dots": lambda m: _count(m["body"], "."),
    "dashes": lambda m: _count(m["body"], r"\-"),
    "spaces": lambda m: _count(m["body"], " "),
    "parens": lambda m: _count(m["body"], "()"),
    "groups": lambda m: F.size(F.regexp_extract_all(m["body"], F.lit("[0-9]+"), F.lit(0))),
    "longest": lambda m: F.coalesce(F.array_max(F.transform(
        F.regexp_extract_all(m["body"], F.lit("[0-9]+"), F.lit(0)), F.char_length)), F.lit(0)),
    "last_group": lambda m: F.char_length(F.regexp_extract(m["body"], "([0-9]+)[^0-9]*$", 1)),
    "suffix": lambda m: m["body"].rlike(r"(?:\.|dot[)\]]) ?[A-Za-z]{2,}$").cast("int"),
    "word_after": lambda m: m["after"].rlike("^[A-Za-z0-9@_]").cast("int"),
    "quoted": lambda m: m["before"].rlike("[\"'=:]$").cast("int"),
    "says_call": lambda m: _says(m, "tel|phone|call|mobile|fax|reach"),
    "says_mail": lambda m: _says(m, "e-?mail|contact|write"),
    "says_pay": lambda m: _says(m, "card|visa|pay|credit"),
    "says_net": lambda m: _says(m, "ip|host|server|address"),
    "says_code": lambda m: _says(m, "token|key|version|isbn|order|id|page|no"),
}


def _kind(m: Column) -> Column:
    """The kind that a candidate would be, by its shape."""
    n = F.char_length(_digits(m["body"]))
    return (F.when(m["body"].rlike(r"@|\(at\)|\[at\]"), "email")
            .when(m["body"].rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
            .when(n >= 13, "card").otherwise("phone"))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``cand``: generated spans with kind, features and whether they are
    base spans (``label``) or touch one (``taken``)."""
    for g, pattern in GENERATORS.items():
        docs = docs.withColumn(f"__{g}", matches(F.col("text"), pattern, None))
    base = F.col("base")

    def judged(m):
        kind = _kind(m)
        touch = lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"])
        return F.struct(
            kind.alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"),
            F.exists(base, lambda s: touch(s) & (s["kind"] == kind)).cast("double").alias("label"),
            F.exists(base, touch).alias("taken"),
            *[f(m).cast("double").alias(name) for name, f in FEATURES.items()])

    return (docs.withColumn("cand", F.transform(F.concat(*[f"__{g}" for g in GENERATORS]), judged))
            .drop(*[f"__{g}" for g in GENERATORS]))


def _tree_sql(node, names: list[str]) -> str:
    if node.numDescendants() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    test = f"c.{names[split.featureIndex()]} <= {float(split.threshold())!r}"
    return f"CASE WHEN {test} THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


class Model:
    """Score expression over a candidate ``c`` and the threshold of each kind."""

    def __init__(self, sql: str, thresholds: dict[str, float]):
        self.sql, self.thresholds = sql, thresholds


def _shares(counts: dict[tuple, int], most: int) -> dict[tuple, float]:
    """Share of each group to take, for groups as equal as they can be and ``most`` rows in all."""
    shares = {}
    for i, (group, n) in enumerate(sorted(counts.items(), key=lambda g: (g[1], g[0]))):
        take = min(n, max(1, most // (len(counts) - i)))
        shares[group], most = take / n, most - take
    return shares


def fit(docs: DataFrame, sample_candidates: int = SAMPLE_CANDIDATES) -> Model | None:
    """Fit trees on about ``sample_candidates`` candidates, and thresholds on all held-back ones."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(
        candidates(base_spans(docs)).select("doc_id", F.explode("cand").alias("c")).select("doc_id", "c.*")
        .withColumn("held", F.pmod(F.xxhash64("doc_id", "start"), F.lit(4)) == 0))
    counts = {(r["kind"], r["label"]): r["n"] for r in
              rows.where("not held").groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in counts}) < 2:
        return None
    share = F.expr("CASE " + " ".join(f"WHEN kind = '{k}' AND label = {y!r}D THEN {x!r}D"
                                      for (k, y), x in _shares(counts, sample_candidates).items()) + " END")
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "start", "stop"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names = list(FEATURES)
    picked = (rows.where("not held").withColumn("share", share).where(draw < F.col("share"))
              .select("doc_id", "start", "stop", "label", (1 / F.col("share")).alias("weight"), *names))
    # in one order, so that every run fits the same trees
    picked = scratch.save(picked.coalesce(1).sortWithinPartitions("doc_id", "start", "stop", "label", *names))
    if picked.select("label").distinct().count() < 2:
        return None
    vec = VectorAssembler(inputCols=names, outputCol="x")
    gbt = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                        stepSize=0.3, seed=7)
    model = gbt.fit(vec.transform(picked.coalesce(1)))
    trees = list(zip(model._java_obj.trees(), model.treeWeights))
    margin = " + ".join(f"{float(w)!r} * ({_tree_sql(t.rootNode(), names)})" for t, w in trees)
    sql = f"1.0D / (1.0D + exp(-2.0D * ({margin})))"
    scored = rows.where("held").select("kind", "label", F.struct(*names).alias("c")).withColumn("score", F.expr(sql))
    bins = (scored.groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("bin"))
            .agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect())
    thresholds = {}
    for kind in KINDS:
        yes = n = 0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            yes, n = yes + b["yes"], n + b["n"]
            if b["bin"] >= 50 and yes >= EXAMPLES and yes >= PRECISION * n:
                thresholds[kind] = b["bin"] / 100
    return Model(sql, thresholds)


def find(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (base and added), each (start, rank, kind, stop)."""
    keep = [F.col(c).alias(f"__in_{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = base_spans(out)
    if model is None or not model.thresholds:
        out = out.withColumn("spans", F.col("base"))
    else:
        least = " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in model.thresholds.items())
        rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
        out = candidates(out)
        added = F.expr(
            f"transform(filter(cand, c -> NOT c.taken AND ({model.sql}) >= (CASE c.kind {least} ELSE 2.0D END)), "
            f"c -> named_struct('start', c.start, 'rank', CASE c.kind {rank} END, 'kind', c.kind, 'stop', c.stop))")
        out = out.withColumn("spans", F.array_sort(F.array_union("base", F.coalesce(added, F.array())))).drop("cand")
    return out.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)], "base", "spans")


def joined(spans: str) -> Column:
    """kind:start:stop of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null."""
    names = docs.columns
    marked = find(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]), model,
                  f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    text = F.col(f"c{names.index(text_col)}").cast("string")
    walked = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out")))
        .otherwise(F.struct(s["stop"].alias("at"),
                            F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]),
                                     F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    new = F.when(F.size("spans") > 0, walked).otherwise(text)
    return marked.select(*[(new if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
