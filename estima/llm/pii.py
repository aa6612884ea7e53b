"""Personal data by bootstrapped contextual extraction, in DataFrame functions only (operator 4).

Base identifiers come from four patterns (email, ip, card, phone), leftmost and not
overlapping per kind; a match that fails its kind's check is dropped. Positions are code
points: the text is split at the matches, so a match starts after all pieces and matches
before it.

The base identifiers are the seeds. Every token with a digit or an @ is a candidate; the word
before it, and the words around it, are its patterns. Patterns and candidate surfaces form a
graph whose edges count co-occurrences. Rounds of grouped sums score it per kind: a pattern is
as good as the average score of what it surrounds (shrunk by its support), a surface that is
no seed as good as its other patterns. Tokens that no base match covers, surrounded by a pattern
of high confidence and wide support and shaped like its kind, become further spans. Joins on
patterns stay even when one word stands before a third of all candidates.

Defined cases: a null text is the empty text; empty texts have no spans; very long texts are
searched in full; repeated rows get the same spans; an empty table gives no rows. Extra
columns are ignored by :func:`find_pii` and kept by :func:`redact`.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estima.llm.common import join_unique, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Repetitions are possessive, and an attempt starts where a
#: run starts or the last match ended; neither changes what is found, only what it costs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word, and what follows it if that has a digit or an @ (the token and the next word).
CONTEXT = r"(?<!\S)(\S++)\s++(?=(\S*?[0-9@]\S*+)(?:\s++(\S++))?)"
#: Shapes a discovered token must have, by kind.
SHAPES = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9]{1,3}(?:[.,:-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[.-]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9](?:[().-]{0,2}[0-9]){6,14}$",
}
#: Rounds over the graph, least confidence of a pattern, least seeds around it, shrinkage.
ROUNDS, CONFIDENCE, SUPPORT, SHRINK = 3, 0.9, 8, 0.5


#: Code points of a piece of text.
CUT = 1024
#: Running sums are taken in blocks of so many matches: an array grows by copying.
BLOCK = 64


def _running(values: Column, start: Column, then: Callable[[Column, Column], Column] = operator.add) -> Column:
    """``start``, start + v1, start + v1 + v2, ...: what ``then`` makes of the values before each."""
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, first, lambda acc, v: F.struct(then(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                       lambda acc: acc["out"])


def _blocks(values: Column, kind: str) -> Column:
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)), lambda i: F.slice(values, i, BLOCK))).otherwise(
        F.array().cast(f"array<array<{kind}>>"))


def _located(docs: DataFrame, text: str, searches: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each search (name: pattern, condition) a column ``name``: the matches in the column
    ``text`` as an array of structs (start, hit). Each step is a projection of its own, as its
    result is used more than once."""
    none, numbers = F.array().cast("array<string>"), "array<int>"
    names = list(searches)
    c = lambda kind, n: F.col(f"__{kind}_{n}")
    step = lambda df, kind, of: df.select("*", *[of(n).alias(f"__{kind}_{n}") for n in names])
    out = step(docs, "hit", lambda n: F.when(searches[n][1], F.regexp_extract_all(text, F.lit(searches[n][0]), F.lit(0))).otherwise(none))
    out = step(out, "gap", lambda n: F.when(F.size(c("hit", n)) > 0, F.transform(F.split(text, searches[n][0], -1), lambda x: F.length(x))).otherwise(
        F.array().cast(numbers)))
    out = step(out, "step", lambda n: F.zip_with(c("gap", n), c("hit", n), lambda g, h: g + F.coalesce(F.length(h), F.lit(0))))
    out = step(out, "block", lambda n: _blocks(F.when(F.size(c("hit", n)) > 0, c("step", n)).otherwise(F.array().cast(numbers)), "int"))
    out = step(out, "from", lambda n: _running(F.transform(c("block", n), lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y)), F.lit(0)))
    out = step(out, "at", lambda n: F.flatten(F.zip_with(c("block", n), c("from", n), lambda b, at: _running(b, at))))
    found = lambda n: F.zip_with(F.zip_with(c("at", n), c("gap", n), lambda a, g: a + g), c("hit", n),
                                 lambda a, h: F.struct(a.alias("start"), h.alias("hit")))
    out = out.select("*", *[F.filter(found(n), lambda x: x["hit"].isNotNull()).alias(n) for n in names])
    return out.drop(*[f"__{k}_{n}" for k in ("hit", "gap", "step", "block", "from", "at") for n in names])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _ip_ok(c: Column) -> Column:
    # leading zeros aside, at most 255
    return F.forall(F.split(c, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_ok(c: Column) -> Column:
    d = _digits(c)
    return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(False)


def _phone_ok(c: Column) -> Column:
    return F.length(_digits(c)).between(9, 15)


def _searched(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``spans`` (structs start, kind, end of the base identifiers, in order; kind: the
    place in KINDS), ``seeds`` (the same with the text) and ``candidates`` (structs before, after,
    token, start, end)."""
    t = F.col(text)
    has_digit = t.rlike("[0-9]")
    checks = ((EMAIL, t.contains("@"), lambda c: F.lit(True)), (IP, has_digit, _ip_ok), (CARD, has_digit, _card_ok), (PHONE, t.contains("+"), _phone_ok))
    searches = {f"__k{k}": (pattern, needs) for k, (pattern, needs, _) in enumerate(checks)}
    got = _located(docs, text, searches | {"__context": (CONTEXT, has_digit | t.contains("@"))})

    def spans_of(k: int) -> Column:
        valid = F.filter(f"__k{k}", lambda x: checks[k][2](x["hit"]))
        return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), (x["start"] + F.length(x["hit"])).alias("end"),
                                                     x["hit"].alias("hit")))

    def group(i: int) -> Column:
        return F.when(F.size("__context") > 0, F.regexp_extract_all(t, F.lit(CONTEXT), F.lit(i))).otherwise(F.array().cast("array<string>"))

    got = got.select("*", group(1).alias("__before"), group(2).alias("__token"), group(3).alias("__after"))
    rows = F.arrays_zip("__context", "__before", "__token", "__after")

    def candidate(x: Column) -> Column:
        # the token without opening marks and what ends it
        core = F.regexp_replace(x["__token"], r"^[\"'<\[{]+", "")
        start = x["__context"]["start"] + F.length(x["__context"]["hit"]) + F.length(x["__token"]) - F.length(core)
        core = F.regexp_replace(core, r"[^A-Za-z0-9]+$", "")
        return F.struct(F.lower(x["__before"]).alias("before"), F.lower(x["__after"]).alias("after"), core.alias("token"), start.alias("start"),
                        (start + F.length(core)).alias("end"))

    got = got.withColumns({"seeds": F.array_sort(F.concat(*[spans_of(k) for k in range(len(KINDS))])), "candidates": F.transform(rows, candidate)})
    got = got.withColumn("spans", F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return got.drop(*searches, "__context", "__before", "__token", "__after")


def _edges(found: DataFrame) -> DataFrame:
    """Occurrences of candidates: row, token, start, end, kind (of the seed that starts in it, else
    null), covered (a base span overlaps it), pattern.

    Seeds and candidates of a text are laid out side by side and swept in the order of their places,
    forwards for what began before a candidate and backwards for what begins in it: a text with many
    identifiers costs a sort, not all pairs of them."""
    none = lambda kind: F.lit(None).cast(kind)
    begins = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.hit").alias("hit"))
    there = F.size("candidates") > 0
    seeds = found.where(there & (F.size("seeds") > 0)).select("row", F.explode("seeds").alias("s")).select(
        "row", F.col("s.start").alias("start"), F.lit(1).alias("seed"), F.col("s.kind").alias("order"), F.col("s.end").alias("reach"), begins.alias("begins"),
        none("string").alias("token"), none("int").alias("end"), none("string").alias("before"), none("string").alias("after"))
    tokens = found.where(there).select("row", F.explode("candidates").alias("c")).where("c.token != ''").select(
        "row", F.col("c.start").alias("start"), F.lit(0).alias("seed"), F.lit(0).alias("order"), none("int").alias("reach"),
        none("struct<start:int,kind:int,hit:string>").alias("begins"), F.col("c.token").alias("token"), F.col("c.end").alias("end"),
        F.col("c.before").alias("before"), F.col("c.after").alias("after"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forwards = Window.partitionBy("row").orderBy("start", "seed").rowsBetween(*so_far)  # a seed at the same place is not before
    backwards = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("seed").desc(), F.col("order").desc()).rowsBetween(*so_far)
    one = seeds.unionByName(tokens).withColumn("__reach", F.max("reach").over(forwards)).withColumn("__next", F.last("begins", True).over(backwards))
    one = one.where("seed = 0")
    inside = F.coalesce(F.col("__next.start") < F.col("end"), F.lit(False))
    one = one.withColumn("covered", inside | F.coalesce(F.col("__reach") > F.col("start"), F.lit(False)))
    one = one.withColumn("kind", F.when(inside, F.col("__next.kind")))
    # a seed's surface is all of it, not only the token that it starts in
    one = one.withColumn("token", F.when(inside, F.col("__next.hit")).otherwise(F.col("token")))
    # a token inside an identifier of several words is neither a seed nor free
    one = one.where(~F.col("covered") | F.col("kind").isNotNull())
    patterns = F.array(F.concat(F.col("before"), F.lit("\t")), F.concat(F.col("before"), F.lit("\t"), F.coalesce("after", F.lit(""))))
    return one.select("row", "token", "start", "end", "kind", "covered", F.explode(patterns).alias("pattern"))


def _scored(edges: DataFrame, rounds: int) -> DataFrame:
    """Patterns with the scores s0 ... s3 of the kinds and their supports u0 ... u3 (distinct seeds)."""
    graph = written(edges.groupBy("pattern", "token").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "pii-graph")
    total = graph.count()
    ks = range(len(KINDS))
    seeds = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in ks]
    own = graph.select("pattern", "token", "kind", *[s.alias(f"i{k}") for k, s in zip(ks, seeds, strict=True)])
    patterns = None
    for r in range(rounds):
        # a surface counts once for a pattern, however often copies repeat it
        patterns = own.groupBy("pattern").agg(F.count("*").alias("m"), *[(F.sum(f"i{k}") / (F.count("*") + SHRINK)).alias(f"s{k}") for k in ks],
                                              *[F.count_if(F.col("kind") == k).alias(f"u{k}") for k in ks])
        patterns = written(patterns, "pii-patterns")
        if r + 1 == rounds:
            break
        # a surface that is no seed is, for one pattern, as good as its other patterns on average: no
        # pattern confirms itself
        open_ = graph.where("kind is null").select("pattern", "token", "kind")
        met = join_unique(open_, patterns.select("pattern", "m", *[f"s{k}" for k in ks]), "pattern", total, "m")
        sums = met.groupBy("token").agg(F.count("*").alias("c"), F.count("*").alias("met"), *[F.sum(f"s{k}").alias(f"b{k}") for k in ks])
        met = join_unique(met, sums, "token", total, "c")
        free = met.select("pattern", "token", "kind", *[
            F.when(F.col("met") > 1, (F.col(f"b{k}") - F.col(f"s{k}")) / (F.col("met") - 1)).otherwise(0.0).alias(f"i{k}") for k in ks])
        seeded = graph.where("kind is not null").select("pattern", "token", "kind", *[s.alias(f"i{k}") for k, s in zip(ks, seeds, strict=True)])
        own = seeded.unionByName(free)
    return patterns


def discovered(found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Spans that patterns of high confidence add: row, extra (array of structs start, kind, end).
    ``found``: row, seeds, candidates, a written table."""
    edges = written(_edges(found), "pii-edges")
    patterns = _scored(edges, rounds)
    good = None
    for k, kind in enumerate(KINDS):
        one = patterns.where((F.col(f"s{k}") >= confidence) & (F.col(f"u{k}") >= support)).select("pattern", "m", F.lit(k).alias("of"), F.lit(SHAPES[kind]).alias("shape"))
        good = one if good is None else good.unionByName(one)
    # confidences over a half belong to one kind only, so a pattern is there once
    free = edges.where("not covered").drop("kind")
    hit = join_unique(free, good, "pattern", edges.count(), "m").where(F.col("of").isNotNull())
    hit = hit.where(F.expr("token rlike shape"))
    return hit.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", F.col("of").alias("kind"), "end"))).alias("extra"))


def _spans(docs: DataFrame, columns: list[Column], keep_text: bool) -> DataFrame:
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("__text"), *columns)
    found = _searched(text, "__text")
    return written(found if keep_text else found.drop("__text"), "pii-spans")


def _with_extra(docs: DataFrame, columns: list[Column], keep_text: bool, rounds: int, confidence: float, support: int) -> DataFrame:
    found = _spans(docs, columns, keep_text)
    extra = discovered(found.select("row", "seeds", "candidates"), rounds, confidence, support).withColumnRenamed("row", "__row")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    got = found.drop("candidates", "seeds").join(extra, F.col("row") == F.col("__row"), "left").drop("__row")
    return got.withColumn("extra", F.coalesce("extra", none))


def _written_out(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, counts of base identifiers, base_sha256, spans, n_discovered."""
    got = _with_extra(docs, [F.col("doc_id")], False, rounds, confidence, support)
    every = F.array_sort(F.concat("spans", "extra"))
    counts = [F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), F.lit(False))).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(_written_out(F.col("spans")), 256).alias("base_sha256"),
                      _written_out(every).alias("spans"), F.size("extra").cast("long").alias("n_discovered"))


def redact(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, n_chars (if there) set anew."""
    names = [F.col(c).alias(f"__in{i}") for i, c in enumerate(docs.columns)]
    got = _with_extra(docs, names, True, rounds, confidence, support)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("__text")
    # where the spans before each end; a span that overlaps one before only adds what lies beyond it
    got = got.withColumn("__every", F.array_sort(F.concat("spans", "extra")))
    got = got.withColumn("__block", _blocks(F.transform("__every", lambda s: s["end"]), "int"))
    got = got.withColumn("__from", _running(F.transform("__block", F.array_max), F.lit(0), F.greatest))
    got = got.withColumn("__at", F.flatten(F.zip_with("__block", "__from", lambda b, at: _running(b, at, F.greatest))))
    # a substring counts from the text's start, so long texts are cut up first
    got = got.withColumn("__cut", F.when(F.size("__every") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        near = F.slice("__cut", first + 1, F.floor(b / CUT).cast("int") - first + 1)
        return F.when(a < b, F.substring(F.array_join(near, ""), a - first * CUT + 1, b - a)).otherwise(F.lit(""))

    pieces = F.zip_with("__every", "__at", lambda s, at: F.concat(
        between(at, s["start"]), F.when(s["start"] >= at, F.get(marks, s["kind"])).otherwise(F.lit(""))))
    rest = between(F.array_max(F.transform("__every", lambda s: s["end"])), F.length(text))
    clean = F.when(F.size("__every") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    fields = dict(docs.dtypes)
    out = [clean.alias(c) if c == "text" else (F.length(clean).cast(fields[c]).alias(c) if c == "n_chars" else F.col(f"__in{i}").alias(c))
           for i, c in enumerate(docs.columns)]
    return got.select(*out)
