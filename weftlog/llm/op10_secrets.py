"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The fixed patterns give the base spans of every whole text. The field tags tokens B (a secret begins), I (it goes on) or
O, with features of a token's shape, of its neighbours and of the file, and is decoded by Viterbi; what it tags, at
least `LEAST` characters of it, is added as kind `crf`, but for what lies inside a base span.

Training: numpy, gradient steps on the exact forward-backward likelihood of token sequences made by a fixed
generator (assignments, connection strings, headers, web tokens, private key blocks, keys in prose, and look-alikes such
as hashes of commits, numbers, paths, ids and plain words), labelled by construction. Nothing of the corpus is used, so a
model never depends on it.

Decoding covers every token of every whole text, once: the best paths through blocks of `crf.BLOCK` tokens are found for all
blocks of a batch at a time, for each tag that may come before, and then chained; a text begins and ends as if between
tokens tagged O. So tagged spans never overlap each other.

Null text is empty; repeated rows each give their row; ties go to the smaller tag; an empty table gives no rows; further
columns are ignored; a very long text or token is read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import crf
from weftlog.llm.common import slices, small_batches, table, texts

KINDS = ["assign", "access", "hex"]
LEAST = 12
#: Bytes of text that are tagged at a time.
PART = 1 << 20
#: A worker's memory of words is emptied beyond this number of tokens.
MOST_CHUNKS = 2_000_000
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted. Runs of AKIA and hex are maximal, so their length can be part of the pattern."""
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# Tokens: runs of word-like characters, or single other characters that aren't blank.
_TOKEN = re.compile(r"[A-Za-z0-9_+/.=-]+|[^\sA-Za-z0-9_+/.=-]")
_CUES = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "basic", "login")
_BEFORE, _AFTER = ("cue", "equals", "colon", "quote", "letters", "url", "dashes"), ("quote", "at")
NAMES = [
    "bias", "letters", "upper", "digits", "mixed", "hexlike", "baselike", "long8", "long16", "long24", "long40", "entropy3", "entropy4", "cue", "equals", "colon", "quote", "sign", "dotted", "slashes",
    "at", "underscore", "url", "dashes", "webtoken", "sized", *[f"prev_{n}" for n in _BEFORE], "prev2_cue", *[f"next_{n}" for n in _AFTER], "file_code",
]
_AT = {n: i for i, n in enumerate(NAMES)}


_HAS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
_HEXLIKE, _BASELIKE = re.compile("[0-9a-f]+"), re.compile("[A-Za-z0-9+/_=-]+")


@lru_cache(maxsize=8)
def _short(long8: bool, upper: bool, cue: bool) -> tuple[str, ...]:
    """Features of a word of letters that has fewer than ten."""
    return ("bias", "letters", *["upper"] * upper, *["long8"] * long8, *["cue"] * cue)


def shape(token: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    out = ["bias"]
    n = len(token)
    if n == 1 and not token.isalnum():
        out.append({"=": "equals", ":": "colon", '"': "quote", "'": "quote", "`": "quote", "@": "at"}.get(token, "sign"))
        return tuple(out)
    low = token.lower()
    cue = any(c in low for c in _CUES)
    if token.isalpha() and n < 10:
        return _short(n >= 8, low != token and token.isupper() and token.isascii(), cue)
    has = [bool(p.search(token)) for p in _HAS]
    if token.isalpha():
        out.append("letters")
    if has == [False, True, False]:
        out.append("upper")
    if has == [False, False, True]:
        out.append("digits")
    if sum(has) >= 2 and has[2]:
        out.append("mixed")
    if n >= 8 and _HEXLIKE.fullmatch(token):
        out.append("hexlike")
    if n >= 12 and has[2] and _BASELIKE.fullmatch(token):
        out.append("baselike")
    out += [f"long{k}" for k in (8, 16, 24, 40) if n >= k]
    if n >= 10:
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
        out += [f"entropy{k}" for k in (3, 4) if entropy >= k]
    if cue:
        out.append("cue")
    if token in (":=", "=="):
        out.append("equals")
    if "." in token[1:-1]:
        out.append("dotted")
    if token.count("/") >= 2:
        out.append("slashes")
    if "_" in token:
        out.append("underscore")
    if token.startswith("//"):
        out.append("url")
    if token.startswith("-----") or token.endswith("-----"):
        out.append("dashes")
    if token.startswith("eyJ") and token.count(".") == 2 and n >= 40:
        out.append("webtoken")
    if n in (32, 40, 64) and "hexlike" in out:
        out.append("sized")
    return tuple(out)


def features(tokens: list[str], code: bool) -> np.ndarray:
    """One row of 0 and 1 for each token."""
    own = [shape(t) for t in tokens]
    x = np.zeros((len(tokens), len(NAMES)))
    for i, names in enumerate(own):
        for name in names:
            x[i, _AT[name]] = 1
        for name in _BEFORE:
            x[i, _AT[f"prev_{name}"]] = i > 0 and name in own[i - 1]
        x[i, _AT["prev2_cue"]] = any("cue" in own[j] for j in (i - 2, i - 3) if j >= 0)
        for name in _AFTER:
            x[i, _AT[f"next_{name}"]] = i + 1 < len(own) and name in own[i + 1]
        x[i, _AT["file_code"]] = code
    return x


def is_code(text: str) -> bool:
    return "{" in text or "();" in text


class Tagger:
    """Tags all tokens of many texts. A token's shape is a number; the scores of shapes, and of shapes of neighbours, are tables."""

    def __init__(self, weights: np.ndarray, moves: crf.Moves):
        self.w, self.moves = weights, moves
        self.numbers: dict[tuple[str, ...], int] = {(): 0}
        self.rows = [np.zeros(len(NAMES))]
        outer = self

        class Shapes(dict):
            def __missing__(self, token):
                names = shape(token)
                found = outer.numbers.get(names)
                if found is None:
                    found = outer.numbers[names] = len(outer.rows)
                    outer.rows.append(np.isin(NAMES, names).astype(float))
                if len(token) <= 64 and len(self) < MOST_CHUNKS:
                    self[token] = found
                return found

        class Chunks(dict):
            """Number of what stands between blanks; its tokens' shapes are outer.kinds from outer.starts on."""

            def __missing__(self, chunk):
                kinds = [outer.shapes[t] for t in _TOKEN.findall(chunk)]
                outer.starts.append(len(outer.kinds))
                outer.lengths.append(len(kinds))
                outer.kinds.extend(kinds)
                self[chunk] = len(outer.starts) - 1
                return len(outer.starts) - 1

        self.shapes, self.chunks = Shapes(), Chunks()
        self.clear()

    def clear(self) -> None:
        self.chunks.clear()
        self.starts, self.lengths, self.kinds = array("q", [0]), array("q", [3]), array("q", [0, 0, 0])  # number 0: between texts, as far as features reach

    def scores(self, shape_of: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Scores of the tags of each token; shape 0 stands between texts and is O."""
        rows, w = np.array(self.rows), self.w
        before = rows[:, [_AT[n] for n in _BEFORE]] @ w[[_AT[f"prev_{n}"] for n in _BEFORE]]
        after = rows[:, [_AT[n] for n in _AFTER]] @ w[[_AT[f"next_{n}"] for n in _AFTER]]
        cue = rows[:, _AT["cue"]] > 0
        out = (rows @ w)[shape_of]
        out[1:] += before[shape_of[:-1]]
        out[:-1] += after[shape_of[1:]]
        near = np.zeros(len(shape_of), bool)
        near[2:] = cue[shape_of[:-2]]
        near[3:] |= cue[shape_of[:-3]]
        out += near[:, None] * w[_AT["prev2_cue"]] + code[:, None] * w[_AT["file_code"]]
        out[shape_of == 0] = [0, crf.NEVER, crf.NEVER]
        return out

    def spans(self, many: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of what the field tags in each text, LEAST characters or more."""
        if len(self.kinds) > MOST_CHUNKS or sum(map(len, many)) > MOST_CHUNKS:
            self.clear()
        get, numbers, per, found = self.chunks.__getitem__, [0], [1], []
        for text in many:
            before = len(numbers)
            numbers.extend(map(get, text.split()))
            numbers.append(0)
            per.append(len(numbers) - before)
        chunks = np.array(numbers, np.int64)
        size = np.array(self.lengths)[chunks]
        ends = np.cumsum(size)
        kinds = np.array(self.kinds)[np.repeat(np.array(self.starts)[chunks] - (ends - size), size) + np.arange(int(ends[-1]))]
        ends = ends[np.cumsum(per) - 1]  # of the texts, with what follows them
        code = np.repeat([False, *map(is_code, many)], np.diff(np.concatenate([[0], ends])))
        tags = crf.best_paths(self.scores(kinds, code), self.moves)
        for k, text in enumerate(many):
            own, out = tags[ends[k] : ends[k + 1] - 3], []
            if own.any():
                places = [m.span() for m in _TOKEN.finditer(text)]
                for i in np.flatnonzero(own).tolist():
                    if own[i] == 1:
                        out.append(places[i])
                    else:
                        out[-1] = out[-1][0], places[i][1]
            found.append([x for x in out if x[1] - x[0] >= LEAST])
        if sum(map(len, many)) > MOST_CHUNKS:
            self.clear()
        return found


def extra_spans(base: list[tuple[int, int, int]], tagged: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tagged spans that don't lie inside a base span."""
    return [(s, e) for s, e in tagged if not any(x <= s and e <= y for x, _, y in base)]


def generated(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Labelled token sequences: 0 is O, 1 is B, 2 is I."""
    r = random.Random(seed)
    low, b64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(r.choice(low) for _ in range(r.randint(2, 10)))
    prose = lambda k: [(w.capitalize() if r.random() < 0.1 else w + r.choice(["", "", "", "", "."]), 0) for w in (word() for _ in range(k))]
    blob = lambda k, chars: "".join(r.choice(chars) for _ in range(k))
    out = []
    for _ in range(n):
        line = prose(r.randint(1, 6))
        made = r.random()
        secret = r.choice([blob(r.choice([24, 32, 40, 64]), "0123456789abcdef"), blob(r.randint(16, 44), b64), blob(r.randint(12, 24), b64 + "_-+/"), blob(r.randint(16, 40), b64[:26])])
        if made < 0.3:
            quote = r.choice(['"', "'", ""])
            line += [(r.choice(["password", "db_password", "secret", "API_KEY", "auth_token", "client_secret", "token", "credential"]), 0), (r.choice([":", "=", "is"]), 0)]
            line += [(quote, 0)] * bool(quote) + [(secret, 1)] + [(quote, 0)] * bool(quote)
        elif made < 0.4:
            line += [("Authorization", 0), (":", 0), (r.choice(["Bearer", "Basic"]), 0), (secret, 1)]
        elif made < 0.44:
            line += [("Authorization", 0), (":", 0), ("Bearer", 0)] * (r.random() < 0.5) + [("eyJ" + blob(r.randint(12, 30), b64) + "." + blob(r.randint(20, 90), b64 + "_-") + "." + blob(r.randint(20, 43), b64 + "_-"), 1)]
        elif made < 0.47:
            line += [(r.choice(["postgres", "https", "amqp", "redis"]), 0), (":", 0), (f"//{word()}", 0), (":", 0), (blob(r.randint(12, 24), b64), 1), ("@", 0), (f"{word()}.{word()}", 0)]
        elif made < 0.49:
            line += [("-----BEGIN", 0)] + [("RSA", 0)] * (r.random() < 0.5) + [("PRIVATE", 0), ("KEY-----", 0), (blob(64, b64 + "+/"), 1)]
            line += [(blob(64, b64 + "+/"), 2) for _ in range(r.randint(0, 4))] + [(blob(r.randint(8, 63), b64 + "+/") + "=" * r.randint(0, 2), 2), ("-----END", 0), ("PRIVATE", 0), ("KEY-----", 0)]
        elif made < 0.5:
            line += [(r.choice(["https", "http"]), 0), (":", 0), (f"//{word()}.{word()}/{word()}/{r.randint(1, 9999)}", 0), *[(x, 0) for x in (word(), ":", str(r.randint(0, 59)))]]
        elif made < 0.56:
            half = len(secret) // 2
            line += [(r.choice(["secret", "key", "token"]), 0), (":", 0), (secret[:half], 1), (r.choice("!#$%&"), 2), (secret[half:], 2)]
        elif made < 0.63:
            line += [(r.choice(["commit", "sha", "revision", "digest", "build", "uuid", "id"]), 0), (r.choice([blob(r.choice([7, 12, 40]), "0123456789abcdef"), "-".join(blob(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12))]), 0)]
        elif made < 0.7:
            line += [(r.choice(["id", "order", "number", "phone", "total", "key", "token"]), 0), (r.choice([":", "=", "is"]), 0), (blob(r.randint(1, 9), "0123456789"), 0)]
        elif made < 0.8:
            line += [(f"{word()}/{word()}/{word()}.{word()}", 0), (f"{word()}_{word()}", 0), ("=", 0), (word(), 0)]
        elif made < 0.9:
            line += [(f"{word()}.{r.randint(1, 99)}", 0), ("@", 0), (f"mail{r.randint(1, 9)}.{word()}.com", 0), (blob(16, "0123456789"), 0), ("(", 0), (blob(3, "0123456789"), 0), (")", 0)]
        elif made < 0.96:  # junk: words with runs of signs
            sign = [r.choice("*#$%&!") for _ in range(4)]
            line += [(t, 0) for k in range(4) for t in (word() + r.choice(["", str(r.randint(1, 9999)), ""]), *[sign[k]] * 3)]
        elif made < 0.98:  # shouting
            line += [(t, 0) for _ in range(r.randint(3, 12)) for t in ("".join(w.upper() for w in (word(), word() if r.random() < 0.3 else "")) + r.choice(["", "", "."]), *[r.choice("!,?")] * r.choice([0, 1, 2, 2]))]
        line += prose(r.randint(0, 5))
        out.append(([t for t, _ in line], [y for _, y in line]))
    return out


def fit(n: int = 500, seed: int = 11, steps: int = 80) -> tuple[np.ndarray, crf.Moves]:
    """(weights: features x tags, transitions)."""
    data = generated(n, seed)
    return crf.fit([features(tokens, i % 2 == 0) for i, (tokens, _) in enumerate(data)], [tags for _, tags in data], crf.forbidden(3, [(0, 2)], [2]), steps)  # I never follows O


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scanner(weights: np.ndarray, move: crf.Moves):
    def scan(batches):
        tagger = Tagger(weights, move)
        for batch in slices(batches, "text", PART):
            rows, many = [], texts(batch.column("text"))
            for text, tagged in zip(many, tagger.spans(many), strict=True):
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                more = [(s, 3, e) for s, e in extra_spans(base, tagged)]
                whole = joined if not more else ",".join(f"{'crf' if k == 3 else KINDS[k]}:{s}:{e}" for s, k, e in sorted([*base, *more]))
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest(), whole))
            a, b, c, d, e = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d), pa.array(e)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, crf.Moves]:
    return fit()


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all; the field's as kind crf)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scanner(*model()), _OUT)


def redactor(weights: np.ndarray, move: crf.Moves, mask: str):
    def redact(batches):
        tagger = Tagger(weights, move)
        for batch in slices(batches, "text", PART):
            out = []
            for text, tagged in zip(batch.column("text").to_pylist(), tagger.spans(texts(batch.column("text"))), strict=True):
                spans = sorted([(s, e) for s, _, e in base_spans(text)] + tagged) if text else []
                parts, at = [], 0
                for s, e in spans:
                    if e > at:
                        parts += [text[at:s], mask] if s >= at else []
                        at = e
                out.append("".join([*parts, text[at:]]) if spans else text)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(out, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in out], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return redact


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with every span replaced by a mask; overlapping spans by one. A text without spans stays as it is."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))))
    return rows.mapInArrow(redactor(*model(), mask), rows.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
