"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Everything is DataFrame and SQL functions. The fixed patterns give the base spans of every whole text. They are the seeds
of a bootstrap over identifier-like tokens (words with a run of four digits or with an @, and three or more groups of digits):

* an edge joins a token (the instance) to a lexical pattern: the last word or two before it, the first word or two behind
  it, both neighbours, or one of them with the token's shape (runs of digits as 0, of letters as a); words are those within
  `CONTEXT` characters, lower-cased, digits as 0;
* an instance that holds a base span of a kind has confidence 1 for that kind;
* a pattern's score for a kind is the mean confidence of its distinct instances, damped for few of them; an instance's
  confidence is the noisy-or over the best pattern before it, behind it and around it, of those that score at least
  `PATTERN`; both alternate until nothing changes, at most `ROUNDS` times;
* an unseen instance with confidence of at least `ACCEPT` becomes a span of that kind wherever it stands.

Edges are aggregated to distinct (pattern, instance, kind) before they are joined, and patterns and instances are
aggregated in parts, so frequent words or tokens meet as counts only.

Null text is empty; repeated rows each give their row; ties of kinds go to the kind listed first; an empty table gives no
rows; further columns are ignored. Matches are collected in blocks, in linear time. Regular expressions start at run beginnings (or where the last match ended) and use
possessive quantifiers, so that a very long run is read once; they match what the plain forms match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm.common import Written, table

KINDS = ["email", "ip", "card", "phone"]
CONTEXT, ROUNDS, PATTERN, ACCEPT, DAMP = 48, 8, 0.6, 0.9, 2.0
#: Matches that are collected at a time.
MATCHES = 256
_MAIL = "[A-Za-z0-9._%+-]"
#: Java patterns of the four kinds. Numbers of digits are part of those of cards and phones: a run with another number never matches, and no shorter part of it does.
REGEX = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])",
}
_LUHN = """pmod(aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substring({d}, -i, 1)) ELSE int(substring('0246813579', int(substring({d}, -i, 1)) + 1, 1)) END), 10) = 0"""
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> length(ltrim('0', p)) < 3 OR (length(ltrim('0', p)) = 3 AND ltrim('0', p) <= '255'))",
    "card": _LUHN.format(d="replace(replace(x.t, ' ', ''), '-', '')"),
    "phone": "true",
}
#: A text without these holds no match of the kind.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
_SPANS = "array<struct<s:int,k:int,e:int>>"


def _walk(regex: str, keep: str, made: str, kind: str, text: str = "t") -> Column:
    """Array of `made` for the matches x (x.t, from acc.pos + x.a to acc.pos + x.a + x.b) that `keep` holds for; places in code points.

    x.g is what stands between the match before and this one, x.h what follows it; acc.tail the last CONTEXT characters up to the match before.
    """
    r = regex.replace("\\", "\\\\").replace("'", "\\'")
    matches, gaps = f"regexp_extract_all({text}, '{r}', 0)", f"split({text}, '{r}', -1)"
    following = "concat(get(p.gaps, i + 1), coalesce(get(p.found, i + 1), ''), coalesce(get(p.gaps, i + 2), ''))"
    one = f"named_struct('t', get(p.found, i), 'g', get(p.gaps, i), 'h', left({following}, {CONTEXT}), 'a', length(get(p.gaps, i)), 'b', length(get(p.found, i)))"
    tail = f"right(concat(acc.tail, x.g, x.t), {CONTEXT})"
    step = f"(acc, x) -> named_struct('pos', acc.pos + x.a + x.b, 'tail', {tail}, 'got', CASE WHEN {keep} THEN array_append(acc.got, {made}) ELSE acc.got END)"
    state = lambda pos, end, got, of: f"CAST(named_struct('pos', {pos}, 'tail', {end}, 'got', {got}) AS struct<pos:int,tail:string,got:array<{of}>>)"
    block = f"transform(sequence(k, least(k + {MATCHES}, size(p.found)) - 1), i -> {one})"
    inner = f"aggregate({block}, {state('all.pos', 'all.tail', 'array()', kind)}, {step})"
    outer = f"(all, k) -> transform(array({inner}), y -> named_struct('pos', y.pos, 'tail', y.tail, 'got', array_append(all.got, y.got)))[0]"
    blocks = f"aggregate(sequence(0, size(p.found) - 1, {MATCHES}), {state('0', "''", 'array()', f'array<{kind}>')}, {outer}, all -> flatten(all.got))"
    return F.expr(f"transform(array(named_struct('gaps', {gaps}, 'found', {matches})), p -> CASE WHEN size(p.found) = 0 THEN CAST(array() AS array<{kind}>) ELSE {blocks} END)[0]")


def base_spans(text: str = "t") -> Column:
    """The base spans of a text column, sorted by start, then kind."""
    none = F.expr(f"CAST(array() AS {_SPANS})")
    each = []
    for k, kind in enumerate(KINDS):
        made = f"named_struct('s', acc.pos + x.a, 'k', {k}, 'e', acc.pos + x.a + x.b)"
        each.append(F.when(F.col(text).rlike(HINT[kind]), _walk(REGEX[kind], VALID[kind], made, "struct<s:int,k:int,e:int>", text)).otherwise(none))
    return F.sort_array(F.concat(*each))


_BLANK = r"\x20\x09-\x0D"
_GROUPS = r"[(+]?+[0-9]{2,}+(?![A-Za-z@])(?:[ .()/-]{1,2}+[0-9]{2,}+(?![A-Za-z@])){2,}+"
_TOKEN = rf"(?<![^{_BLANK}])(?:{_GROUPS}|(?=[^{_BLANK}@]*+@|(?:[0-9]{{0,3}}+[^{_BLANK}0-9]++)*+[0-9]{{4}})[^{_BLANK}]++)"
_TOKENS = "struct<s:int,e:int,token:string,before:string,after:string>"


def candidates(text: str = "t") -> Column:
    """Identifier-like tokens with their places (outer punctuation trimmed) and the characters before and behind them."""
    trimmed = "regexp_replace(x.t, '^[^A-Za-z0-9+(]+|[^A-Za-z0-9]+$', '')"
    lead = "length(x.t) - length(regexp_replace(x.t, '^[^A-Za-z0-9+(]+', ''))"
    place = f"'s', acc.pos + x.a + {lead}, 'e', acc.pos + x.a + {lead} + length({trimmed})"
    made = f"named_struct({place}, 'token', {trimmed}, 'before', right(concat(acc.tail, x.g), {CONTEXT}), 'after', x.h)"
    return F.when(F.col(text).rlike("@|[0-9]{4}|[0-9]{2}[ .()/-]{1,2}[0-9]{2}"), _walk(_TOKEN, "true", made, _TOKENS, text)).otherwise(F.expr(f"CAST(array() AS array<{_TOKENS}>)"))


def patterns() -> Column:
    """The lexical patterns of a token with its words before (w) and behind (v), as (side, pattern)."""
    w, v = (lambda i: F.get("w", F.size("w") - 1 - i)), (lambda i: F.get("v", F.lit(i)))
    shape = F.regexp_replace(F.regexp_replace("token", "[0-9]+", "0"), "[A-Za-z]+", "a")
    made = [
        ("b", "1", w(0)), ("b", "2", F.concat(w(1), F.lit(" "), w(0))), ("b", "s", F.concat(w(0), F.lit("\t"), shape)),
        ("a", "1", v(0)), ("a", "2", F.concat(v(0), F.lit(" "), v(1))), ("a", "s", F.concat(v(0), F.lit("\t"), shape)),
        ("c", "1", F.concat(w(0), F.lit("\t"), v(0))),
    ]
    each = [F.struct(F.lit(side).alias("side"), F.concat(F.lit(side + kind + " "), words).alias("pattern")) for side, kind, words in made]
    return F.filter(F.array(*each), lambda x: x["pattern"].isNotNull())


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def bootstrap(found: DataFrame, store: Written) -> DataFrame:
    """found (row, base, cands) -> row, extra: spans of accepted tokens."""
    one = found.where(F.size("cands") > 0).select("row", "base", F.explode("cands").alias("c")).where(F.col("c.e") > F.col("c.s"))
    kind = F.expr("get(transform(filter(base, b -> b.s < c.e AND b.e > c.s), b -> b.k), 0)")
    seen = store.write(one.select("row", *[F.col(f"c.{c}").alias(c) for c in ("s", "e", "token", "before", "after")], kind.alias("kind")), "tokens")
    words = lambda c: F.array_remove(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), rf"[{_BLANK}]+"), "")
    pairs = seen.select("token", "kind", words("before").alias("w"), words("after").alias("v")).select("token", "kind", F.explode(patterns()).alias("p"))
    edges = store.write(pairs.groupBy("p.side", "p.pattern", "token").agg(F.min("kind").alias("kind")), "edges")
    total = store.write(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "patterns")
    seeds = store.write(edges.where(F.col("kind").isNotNull()).select("token", "kind", F.lit(1.0).alias("confidence")).distinct(), "seeds")
    known, last = seeds, None
    for step in range(ROUNDS):
        lit = edges.select("pattern", "token").join(known, "token").groupBy("pattern", "kind").agg(F.sum("confidence").alias("sure"))
        scores = lit.join(total, "pattern").select("pattern", "kind", (F.col("sure") / (F.col("n") + DAMP)).alias("score")).where(F.col("score") >= PATTERN)
        sides = edges.where(F.col("kind").isNull()).select("side", "pattern", "token").join(scores, "pattern").groupBy("token", "kind", "side").agg(F.max("score").alias("score"))
        miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6))))
        fresh = sides.groupBy("token", "kind").agg((1 - F.exp(miss)).alias("confidence"))
        known = store.write(seeds.unionByName(fresh).groupBy("token", "kind").agg(F.max("confidence").alias("confidence")), f"known{step}")
        now = tuple(known.agg(F.count(F.lit(1)), F.round(F.sum("confidence"), 3)).first())
        if now == last:
            break
        last = now
    best = known.where(F.col("confidence") >= ACCEPT).groupBy("token").agg(F.max_by(F.col("kind"), F.struct(F.col("confidence"), -F.col("kind"))).alias("found"))
    extra = seen.where(F.col("kind").isNull()).join(best, "token")
    return extra.groupBy("row").agg(F.collect_set(F.struct(F.col("s"), F.col("found").alias("k"), F.col("e"))).alias("extra"))


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    store = Written(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # Rows of one id and text are alike, so they may share what the bootstrap finds.
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("t"), F.length("t"))
    found = store.write(text.select("doc_id", row.alias("row"), base_spans().alias("base"), candidates().alias("cands")), "base")
    extra = bootstrap(found, store)
    whole = found.join(extra, "row", "left").withColumn("all", F.sort_array(F.concat("base", F.coalesce("extra", F.expr(f"CAST(array() AS {_SPANS})")))))
    counts = [F.expr(f"CAST(size(filter(base, b -> b.k = {k})) AS bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return whole.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("`all`").alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
