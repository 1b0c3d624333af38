"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Two bigram models, one of random strings and one of ordinary identifiers, are counted from labelled
samples. Every maximal run of 16 or more token characters is a candidate; it is flagged when its mean
log-likelihood ratio passes a threshold, and nothing else decides. The models are a table of at most
(len(ALPHABET) + 2) ** 2 weights, a fixed bound, so they travel as a literal; the scan is one projection of
SQL functions: no user functions, no shuffle.

samples() is the labelled fixture: random strings of every alphabet in KINDS_OF_RANDOM, and identifiers, words
run together, paths and numbers, all drawn by rule from hashes of a number, so that other numbers are held out.
words_of() adds the words of the corpus at hand to the ordinary class, with as much weight as the fixture's.

Null and empty texts have no spans; texts of any length are scanned whole, in steps about linear in their
length and spans; repeated rows are scanned row by row. Spans that begin at one place come in the order of
KINDS, then markov. Extra columns pass through, but for one named like the output, which it replaces.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.quality_rules import bound

#: The kinds in their order, with their patterns, the group that holds the secret and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A cheaper pattern that every text with a match of the kind also matches.
GATES = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Runs of at least 32 hexadecimal digits are maximal either way, so the longer pattern finds the same spans in fewer steps.
FAST = {"hex": r"[0-9a-f]{32,}", "access": r"AKIA[A-Z0-9]{12,}"}
#: What the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: What counts as a word of a corpus.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{8,}(?![A-Za-z0-9+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
EDGE = "\x02"
PRIOR = 8.0
#: Alphabets of random strings.
KINDS_OF_RANDOM = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "urlsafe": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "lower_digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper_digits": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "hex": "0123456789abcdef",
}
#: Words of code and of four languages, of which ordinary identifiers are made.
WORDS = (
    "account action address array batch block buffer button cache channel check class client code column command config connection content context control count create current data date default delete document element error event field file filter format function group handle header image index input instance item java json label layer length level library limit line list local manager message method model module name network node number object option order output page parameter parent password path pattern point position process product project property provider query queue random record region request resource response result return route row schema script search section select server service session setting source stack start state status step stream string style system table target task template test text thread time token total transaction type update user util value vector version view warning window with worker write "
    "arbeit beispiel dienst einstellung entwicklung gesellschaft geschwindigkeit haupt kunden leistung rechnung sicherheit sprache versicherung verwaltung wirtschaft zeit "
    "ainsi bonjour chose comme donner encore enfant environnement gouvernement heure jour maison monde pouvoir quelque toujours travail vouloir "
    "cuando desarrollo después empresa gobierno hacer información mundo nosotros nuevo persona poder pueblo siempre sociedad trabajo"
)
#: Shapes of ordinary identifiers: separator, capitals, and whether a number follows.
ORDINARY_SHAPES = (("_", "lower", False), ("_", "upper", False), ("-", "lower", True), ("", "camel", False), ("", "lower", False), ("/", "lower", False), ("_", "lower", True), ("", "camel", True), ("=", "lower", False))
#: A mean ratio from which a token counts as random: on held-out samples() it flags under one ordinary token in a thousand.
LEAST_RATIO = 0.5


@dataclass(frozen=True)
class MarkovRatio:
    """weights[a * size + b]: log p(b|a) of random strings less that of identifiers; a token's score is their mean."""

    weights: list[float]
    threshold: float = LEAST_RATIO

    @property
    def size(self) -> int:
        return len(ALPHABET) + 2


def _code(c: Column) -> Column:
    """0: any other character; then the alphabet; last the edge of a token."""
    return F.when(c == EDGE, F.lit(len(ALPHABET) + 1)).otherwise(F.instr(F.lit(ALPHABET), c) * (c != "").cast("int"))


def train(samples: DataFrame, token: str = "token", label: str = "label", part: str | None = None, threshold: float = LEAST_RATIO) -> MarkovRatio:
    """Count both models from labelled tokens (1: random, 0: ordinary); bigrams lean on single characters with the weight of PRIOR counts.

    The counts of equal tokens are summed first, then those of bigrams, so hot tokens cost one row a task.
    Parts of a class (column `part`, few values) weigh as much as its largest, so that a corpus doesn't drown a fixture.
    """
    size = len(ALPHABET) + 2
    own = F.lit("") if part is None else F.col(part)
    tokens = samples.select(F.col(token).alias("t"), F.col(label).cast("int").alias("y"), own.alias("part")).filter(F.col("t").isNotNull() & F.col("y").isNotNull()).groupBy("t", "y", "part").count()
    codes = F.transform(F.split(F.concat(F.lit(EDGE), F.col("t"), F.lit(EDGE)), ""), _code)
    coded = tokens.select("y", "part", "count", codes.alias("c"))
    last = F.size("c") - 1
    pairs = coded.select("y", "part", "count", F.inline(F.zip_with(F.slice("c", F.lit(1), last), F.slice("c", F.lit(2), last), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    rows = pairs.groupBy("y", "part", "a", "b").agg(F.sum("count").alias("n")).collect()  # at most 2 * size ** 2 rows a part
    whole: Counter = Counter()
    for r in rows:
        whole[r.y, r.part] += r.n
    most = {y: max((n for (z, _), n in whole.items() if z == y), default=0) for y in (0, 1)}
    counts: Counter = Counter()
    for r in rows:
        counts[r.y, r.a, r.b] += r.n * most[r.y] / whole[r.y, r.part]
    after = {(y, a): sum(counts[y, a, b] for b in range(size)) for y in (0, 1) for a in range(size)}
    total = {y: sum(after[y, a] for a in range(size)) for y in (0, 1)}
    alone = {(y, b): (sum(counts[y, a, b] for a in range(size)) + 0.5) / (total[y] + 0.5 * size) for y in (0, 1) for b in range(size)}
    logp = lambda y, a, b: math.log((counts[y, a, b] + PRIOR * alone[y, b]) / (after[y, a] + PRIOR))
    return MarkovRatio([round(logp(1, a, b) - logp(0, a, b), 6) for a in range(size) for b in range(size)], threshold)


def ratio(token: Column, model: MarkovRatio) -> Column:
    """The mean log-likelihood ratio of a token's bigrams, edges included."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    t = F.concat(F.lit(EDGE), token, F.lit(EDGE))
    codes = F.transform(F.split(t, ""), _code)
    zero = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("s"))
    step = lambda acc, b: F.struct(b.alias("a"), (acc["s"] + F.when(acc["a"] >= 0, F.get(weights, acc["a"] * model.size + b)).otherwise(F.lit(0.0))).alias("s"))
    return F.aggregate(codes, zero, step, lambda acc: acc["s"] / (F.length(token) + 1))


def samples(spark: SparkSession, n: int = 2000, first: int = 0) -> DataFrame:
    """(token, label, kind): n random strings (1) of each kind and as many ordinary tokens (0) of each shape, by rule; other numbers `first` give others."""
    ids = spark.range(first, first + n, 1, 4).withColumnRenamed("id", "i")
    parts = [ids.select(_random(kind, alphabet).alias("token"), F.lit(1).alias("label"), F.lit(kind).alias("kind")) for kind, alphabet in KINDS_OF_RANDOM.items()]
    parts += [ids.select(_identifier(*shape).alias("token"), F.lit(0).alias("label"), F.lit("{}{}{}".format(*shape)).alias("kind")) for shape in ORDINARY_SHAPES]
    number = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: _draw("number", j, 10_000_000_000).cast("string")), "")
    parts.append(ids.select(number.alias("token"), F.lit(0).alias("label"), F.lit("number").alias("kind")))
    return reduce(DataFrame.unionAll, parts)


def _draw(kind: str, j: Column, m: int) -> Column:
    """A number below m that the row's number i, a kind and j give."""
    return F.pmod(F.xxhash64(F.lit(kind), F.col("i"), j), F.lit(m))


def _random(kind: str, alphabet: str) -> Column:
    """A string of 16 to 48 characters."""
    letter = lambda j: F.lit(alphabet).substr((_draw(kind, j, len(alphabet)) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), (16 + _draw(kind, F.lit(0), 33)).cast("int")), letter), "")


def _identifier(sep: str, case: str, numbered: bool) -> Column:
    """Three to five words, and a number if wanted."""
    kind, words = f"{sep}{case}{numbered}", WORDS.split(" ")
    shaped = {"lower": F.lower, "upper": F.upper, "camel": F.initcap}[case]
    some = F.transform(F.sequence(F.lit(1), (3 + _draw(kind, F.lit(0), 3)).cast("int")), lambda j: shaped(F.get(F.lit(words), _draw(kind, j, len(words)).cast("int"))))
    return F.concat(F.array_join(some, sep), _draw(kind, F.lit(-1), 1000).cast("string") if numbered else F.lit(""))


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, block: int = 256) -> Column:
    """array<int>: before each value, the fold of those ahead of it by an associative op with the neutral `zero`.

    Blocks are folded one by one and then over their ends, as appending to one array copies it at every step.
    """
    fold = lambda xs: F.aggregate(xs, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(v) - 1) / block).cast("int"))), lambda b: fold(F.slice(v, b * block + 1, F.lit(block))))

        def joined(parts: Column) -> Column:
            ends = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
            return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), lambda p, e: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: op(e, x))))

        return bound(blocks, joined)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bound(values, over))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s,e,v>>: start and end (code points, end exclusive) of every match, and the text of a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, m: F.struct(F.length(a).alias("a"), F.length(m).alias("m")))

    def placed(x: Column) -> Column:
        at = running(F.transform(x, lambda z: z["a"] + z["m"]), lambda a, b: a + b, 0)
        starts = F.zip_with(x, at, lambda z, p: F.struct((p + z["a"]).alias("s"), (p + z["a"] + z["m"]).alias("e")))
        return F.zip_with(starts, values, lambda z, v: F.struct(z["s"].alias("s"), z["e"].alias("e"), v.alias("v")))

    return bound(sizes, placed)


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["v"]) >= least)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, array<struct<s,e,v>>: the spans of the fixed patterns."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    out = {}
    for kind, pattern, group, least in KINDS:
        out[kind] = F.when(text.rlike(GATES[kind]), _long(matches(text, FAST.get(kind, pattern), group), least)).otherwise(none)
    return out


def words_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, label): the words of letters alone that stand by themselves, from every text: ordinary (0)."""
    return df.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ORDINARY), F.lit(0))).alias("token"), F.lit(0).alias("label"))


def model_for(df: DataFrame, text: str = "text", threshold: float = LEAST_RATIO) -> MarkovRatio:
    """Models of the fixture's random strings, and of its identifiers and the words of df in equal parts."""
    fixture = samples(df.sparkSession).select("token", "label", F.lit("fixture").alias("part"))
    return train(fixture.unionAll(words_of(df, text).withColumn("part", F.lit("corpus"))), part="part", threshold=threshold)


def scan(df: DataFrame, model: MarkovRatio, text: str = "text", out: str = "spans") -> DataFrame:
    """df and `out`, array<struct<kind,s,e,v>>: base spans, and candidates of a high ratio clear of them; by start, then kind."""
    columns = [c for c in df.columns if c != out]
    df = df.select(F.struct(*[F.col(c) for c in columns]).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    t = F.col("__text")
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    spans = base_spans(t)
    names = [k for k, *_ in KINDS]
    likely = F.filter(F.when(t.rlike(CANDIDATE), matches(t, CANDIDATE)).otherwise(none), lambda x: ratio(x["v"], model) >= model.threshold)
    df = df.select("__row", F.struct(*[spans[k].alias(k) for k in names], likely.alias("markov")).alias("__found"))

    def tagged(kind: str, i: int) -> Column:
        return F.transform(F.col("__found")[kind], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["v"].alias("v")))

    every = F.array_sort(F.concat(*[tagged(k, i) for i, k in enumerate([*names, "markov"])]))
    clear = bound(every, lambda x: F.when(F.size(F.col("__found")["markov"]) == 0, x).otherwise(_clear(x, len(names))))
    return df.select(*[F.col("__row")[c].alias(c) for c in columns], clear.alias(out))


def _clear(spans: Column, last: int) -> Column:
    """spans, in order, without those of kind `last` that overlap one of another kind."""
    far = 2**31 - 1
    ends = running(F.transform(spans, lambda x: F.when(x["k"] < last, x["e"]).otherwise(F.lit(0))), F.greatest, 0)
    starts = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["k"] < last, x["s"]).otherwise(F.lit(far)))), F.least, far))
    judged = F.zip_with(spans, F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s"))), lambda x, b: F.struct(x.alias("x"), ((x["k"] < last) | ((b["e"] <= x["s"]) & (x["e"] <= b["s"]))).alias("ok")))
    return F.transform(F.filter(judged, lambda z: z["ok"]), lambda z: z["x"])


def redact(df: DataFrame, model: MarkovRatio, text: str = "text", mark: str = "[secret]", chunk: int = 4096) -> DataFrame:
    """df with every span of its texts replaced by `mark`; overlapping spans give one mark. Null texts stay null.

    What is kept is cut from pieces of `chunk` code points, as cutting at a place of a text walks to it.
    """
    found = scan(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(text).alias("__text")), model, "__text", "__spans")
    t = F.col("__text")
    ends = F.transform("__spans", lambda x: x["e"])
    gaps = F.zip_with(F.col("__spans"), running(ends, F.greatest, 0), lambda x, e: F.struct(e.alias("a"), x["s"].alias("b")))

    def part(pieces: Column, a: Column, b: Column) -> Column:
        one, two = (a / chunk).cast("int"), (b / chunk).cast("int")
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        inside = piece(one).substr(a - one * chunk + 1, b - a)
        over = F.concat(piece(one).substr(a - one * chunk + 1, F.lit(chunk)), F.array_join(F.slice(pieces, one + 2, F.greatest(two - one - 1, F.lit(0))), ""), piece(two).substr(F.lit(1), b - two * chunk))
        return F.when(one == two, inside).otherwise(over)

    def joined(pieces: Column) -> Column:
        kept = F.transform(F.filter(gaps, lambda g: g["b"] >= g["a"]), lambda g: F.concat(part(pieces, g["a"], g["b"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part(pieces, F.array_max(ends), F.length(t)))

    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    new = F.when(F.size("__spans") > 0, bound(pieces, joined)).otherwise(t)
    return found.select(*[new.alias(c) if c == text else F.col("__row")[c].alias(c) for c in df.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1(docs: DataFrame) -> DataFrame:
    """The digest of each document's secrets: base counts and their hash, then all spans."""
    docs = docs.select("doc_id", "text")
    found = scan(docs, model_for(docs))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
