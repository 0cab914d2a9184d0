"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary words."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftlens.llm.common import let, match_spans, running, table, whole
from driftlens.session import cut_lineage

# The kinds in their order and the pattern of each.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so their least lengths are part of the patterns; a short assigned value still uses up its text.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
LEAST = 6              # characters of an assigned value

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOL = "A-Za-z0-9+/_=-"
TOKEN = 12             # shortest string that the models judge
SAMPLE_DOCS = 2000     # documents, about, that each model is fitted on
MARGIN = 12.0          # least log-likelihood ratio of a secret, in nats
MEAN_MARGIN = 0.7      # and the least per step from character to character
SPANS = "array<struct<s:bigint,e:bigint,m:string>>"


def base_spans(text: Column) -> dict[str, Column]:
    """The matches of each fixed pattern that are long enough; a plain search first tells documents without any."""
    none = F.array().cast(SPANS)
    small = F.lower(text)
    named = [F.contains(small, F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    found = {
        "assign": F.when(reduce(Column.__or__, named), F.filter(
            match_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST)),
        "access": F.when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS)),
        "hex": F.when(text.rlike(HEX), match_spans(text, HEX)),
    }
    return {kind: F.coalesce(spans, none) for kind, spans in found.items()}


def scanned(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """A narrow row per document: its fixed-pattern spans and the strings the models have to judge."""
    body = whole(F.col(text))
    tokens = match_spans(body, f"(?<![{SYMBOL}])[{SYMBOL}]{{{TOKEN},}}")
    return docs.select(
        F.col(ident).alias("id"), *[spans.alias(kind) for kind, spans in base_spans(body).items()],
        tokens.alias("tokens"),
    )


def transitions(strings: DataFrame) -> DataFrame:
    """(pair, n): how often one character follows another, over a column ``word`` of strings. At most 67 x 67 rows."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    steps = strings.where(F.length("word") >= 2).select("word", at)
    code = lambda shift: F.instr(F.lit(ALPHABET), F.substring("word", F.col("at") + shift, F.lit(1)))
    pair = code(0) * (len(ALPHABET) + 1) + code(1)
    return steps.select(pair.alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame) -> list[float]:
    """Transition probabilities by pair, with add-one smoothing. The table is of fixed size."""
    n = len(ALPHABET) + 1
    seen = [1.0] * (n * n)
    for row in counts.collect():
        seen[row["pair"]] += row["n"]
    return [seen[a * n + b] / sum(seen[a * n:(a + 1) * n]) for a in range(n) for b in range(n)]


def identifiers(words: Column) -> Column:
    """Names as programs write them, one of each two neighbouring words of an array, in a style chosen by their hash, and lines of one symbol."""
    def name(a: Column, b: Column) -> Column:
        digit = F.pmod(F.xxhash64(b), F.lit(10)).cast("string")
        symbol = F.element_at(F.array(*[F.lit(c) for c in "-=_/+"]), F.pmod(F.xxhash64(b), F.lit(5)).cast("int") + 1)
        styles = [
            F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat_ws("/", a, b), F.concat(a, F.initcap(b), F.initcap(a)),
            F.concat(F.initcap(a), F.initcap(b), digit), F.upper(F.concat_ws("_", a, b)), F.concat_ws("_", a, digit, b), F.concat_ws("-", a, digit, b), F.concat(a, digit, b),
            F.repeat(symbol, F.lit(TOKEN)),
        ]
        return F.element_at(F.array(*styles), F.pmod(F.xxhash64(a, b), F.lit(len(styles))).cast("int") + 1)

    plain = F.transform(F.filter(words, lambda w: w.rlike("^[A-Za-z]+$")), F.lower)
    return let(plain, lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), name))


def train(docs: DataFrame, base: DataFrame, text: str, ident: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[float], ...]:
    """Fit the models of random strings, of words and of names on labelled strings of about ``sample_docs`` documents each, chosen by a hash of the identifier.

    Random strings are the values the fixed patterns found; ordinary strings are the other words of sampled documents
    and names made of them. Of long words that mix letters and digits, among which unknown secrets would be, only the
    small letters between other characters count. Equal texts count once.
    """
    share = lambda n: F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_000)) < int(1e6 * min(1.0, sample_docs / max(1, n)))
    hits = base.where(F.size("assign") + F.size("access") + F.size("hex") > 0)
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    known = hits.where(share(hits.count())).select(F.explode(F.concat(
        F.transform("assign", value), F.transform("access", lambda x: x["m"]), F.transform("hex", lambda x: x["m"]))).alias("word"))
    words = docs.select(F.col(ident).alias("id"), whole(F.col(text)).alias("body")).where(share(base.count())).dropDuplicates(["body"])
    rest = F.regexp_replace(F.regexp_replace("body", f"(?:{ASSIGN})|{ACCESS}", " "), "[0-9a-f]{24,}", " ")
    mixed = lambda w: (F.length(w) >= TOKEN) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    parts = lambda w: F.when(mixed(w), F.regexp_extract_all(w, F.lit("[a-z]{4,}"), F.lit(0))).otherwise(F.array(w))
    strings = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(f"[{SYMBOL}]{{4,}}"), F.lit(0)), parts))
    other = words.select(strings.alias("words"))
    names = other.select(F.explode(identifiers(F.col("words"))).alias("word"))
    return tuple(shares(transitions(sample)) for sample in (known, other.select(F.explode("words").alias("word")), names))


def ratio(word: Column, model: tuple[list[float], ...]) -> Column:
    """Log-likelihood ratio of a string, random against the likelier of the two models of ordinary ones.

    Known secrets use few alphabets, so half of the weight of the random model goes to any character of the string's own
    alphabet following any other: small letters, capitals, digits and symbols, as far as the string has them.
    """
    n = len(ALPHABET) + 1
    table_of = lambda numbers: F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")  # noqa: E731  folded to one constant
    random, words, names = table_of(model[0]), *(table_of(list(map(math.log, shares))) for shares in model[1:])
    classes = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[+/_=-]", 5))
    size = reduce(Column.__add__, [F.when(word.rlike(c), k).otherwise(0) for c, k in classes])

    def total(x: Column) -> Column:
        codes = x["codes"]
        step = lambda a, b: (a * n + b + 1).cast("int")
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), step)
        added = lambda gain: F.aggregate(pairs, F.lit(0.0), lambda so_far, p: so_far + gain(p))
        known = added(lambda p: F.log((F.element_at(random, p) + 1 / x["size"]) / 2))
        return known - F.greatest(*[added(lambda p, m=m: F.element_at(m, p)) for m in (words, names)])

    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(F.struct(codes.alias("codes"), size.alias("size")), total)


def secret(word: Column, llr: Column, margin: float = MARGIN) -> Column:
    """Whether a ratio is high enough, in all and per step."""
    return (llr >= margin) & (llr >= MEAN_MARGIN * (F.length(word) - 1))


def untouched(tokens: Column, fixed: Column) -> Column:
    """The tokens that overlap no fixed span. Tokens come in order and apart from each other.

    Both lie in one order of start; the furthest end of the fixed spans before a token and the next start after it tell.
    """
    row = lambda x, no: F.struct(x["s"].alias("s"), F.lit(no).alias("token"), x["e"].alias("e"), x["m"].alias("m"))
    every = F.array_sort(F.concat(F.transform(fixed, lambda x: row(x, 0)), F.transform(tokens, lambda x: row(x, 1))))
    far = F.lit(2 ** 62)

    def kept(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: F.when(y["token"] == 0, y["e"]).otherwise(-far)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["token"] == 0, y["s"]).otherwise(far))), F.least))
        met = F.transform(x, lambda y, i: F.struct(y["s"].alias("s"), y["e"].alias("e"), y["m"].alias("m"), y["token"].alias("token"), i.alias("i")))
        free = let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda z: F.filter(
            met, lambda y: (y["token"] == 1) & (F.get(z["ends"], y["i"]) <= y["s"]) & (F.get(z["starts"], y["i"]) >= y["e"])))
        return F.transform(free, lambda y: F.struct(y["s"], y["e"], y["m"]))

    return F.when((F.size(fixed) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(every, kept))


def numbered(no: int):
    """Gives a span the number of its kind."""
    return lambda x: F.struct(
        x["s"].alias("s"), F.lit(no).alias("kind_no"), x["e"].alias("e"), x["m"].alias("m"), F.lit(None).cast("double").alias("llr"))


def secret_spans(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, margin: float = MARGIN, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and ``spans``, array<struct<s, kind_no, e, m, llr>> in order of start, then kind.

    The fixed patterns give their matches. The models judge every string of 12 or more characters of the base64 alphabet
    that touches no fixed match, and add those far likelier under the model of random strings. Offsets
    count code points, ends are exclusive. Null and empty texts have no spans; repeated rows are judged row by row; an
    empty table gives no rows. Without a single labelled string the models are uniform and add nothing.
    """
    base = cut_lineage(scanned(docs, text, ident))
    model = train(docs, base, text, ident, sample_docs)
    fixed = base.withColumn("fixed", F.concat(*[F.transform(kind, numbered(no)) for no, kind in enumerate(KINDS[:3])]))
    judged = fixed.withColumn("free", untouched(F.col("tokens"), F.col("fixed"))).withColumn("judged", F.transform("free", lambda x: F.struct(
        x["s"].alias("s"), F.lit(3).alias("kind_no"), x["e"].alias("e"), x["m"].alias("m"), ratio(x["m"], model).alias("llr"))))
    added = F.filter("judged", lambda x: secret(x["m"], x["llr"], margin))
    return judged.select(F.col("id").alias(ident), F.array_sort(F.concat("fixed", added)).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda no: F.size(F.filter("spans", lambda x: x["kind_no"] == no)).cast("bigint")
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind_no"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind_no"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
