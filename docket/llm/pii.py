"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns (``STRICT``) find e-mail addresses, IPv4 addresses, card and
phone numbers; matches that fail their test (``_holds``) are dropped.  These
*base* spans always stay.  Looser patterns (``LOOSE``) propose further spans in
the text left between them: addresses written out, numbers without a prefix or
with other separators, IPv6 addresses, personal names.

Three labelers vote on every base span and every proposal: a *regex* on its
form, a *gazetteer* (domains, calling codes, issuers, address ranges, given
names) and a *context* labeler (cue words shortly before it).  Expectation
maximisation estimates for each kind how often a span is true and how reliable
each labeler is, from the counts of the eight vote patterns; its posteriors
are the soft labels on which the final span classifier is trained: naive Bayes
over the votes, the shape of the span, its length and the words around it,
hashed to ``BUCKETS`` values each.  A proposal with log odds above 0 is added.

Everything is learned from all rows.  The votes go through one aggregate of
eight counts a kind, the classifier through one of at most kinds x features x
``BUCKETS`` rows, whatever the input's size; no text is shuffled.

Offsets count code points, ends are exclusive; within a kind matches are
leftmost and do not overlap.  A pattern's matches and the gaps between them
give the offsets by prefix sums over blocks of matches, so a long text costs in
proportion to its length; the patterns do not back off (possessive, anchored
at the start of a run), so none is quadratic or deep.

Nulls and empty texts have no span; every row is read on its own, repeated or
not; equal starts of two kinds are listed by kind.  An empty table gives no
rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone", "name")
BASE = KINDS[:4]
#: The strict patterns.  A match starts where a run of its first
#: characters does, or right after the match before.
_LOCAL, _DIGIT = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++", r"(?:\G|(?<![0-9]))[0-9]++"
STRICT = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGIT + r"\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind that could hold.
_HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}",
         "phone": r"\+[0-9][\x20().0-9-]"}
#: Common given names of the languages in hand.
GIVEN_NAMES = (
    "Alexander Alice Amelie Anna Antoine Antonio Bruno Camille Carlos Carmen Charlotte Christian "
    "Christine Claire Claudia Daniel David Diego Elena Elisabeth Emily Emma Fernando Francisco "
    "Friedrich Georg George Hannah Hans Heinrich Henri Isabel Jacques James Jan Javier Jean Johann "
    "John Jorge José Josef Juan Julia Julien Jürgen Karl Katharina Klaus Laura Louis Lucas Lucía Luis "
    "Manuel Marc Margaret María Marie Martin Mary Matthias Michael Miguel Nicolas Olivia Pablo Patricia "
    "Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sarah Sebastian Sofia Stefan Susan Thomas "
    "Ursula William Wolfgang").split()
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra|Doña|Don)\.? "
_FULL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?+(?: \p{Lu}\p{Ll}+){0,2}+"
#: Proposals: (hint, pattern) for each kind.
LOOSE = {
    "email": (r"[\[({]at[\])}]| at [A-Za-z0-9-]+ dot ",
              _LOCAL + r"(?: ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]++"
                       r"(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f:]*:",
           r"(?:\G|(?<![0-9A-Za-z:]))[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])"),
    "card": (r"[0-9]{4}[./_][0-9]{4}", r"(?:\G|(?<![0-9]))[0-9]{4}+(?:[./_][0-9]{3,6}+){2,3}+(?![0-9])"),
    "phone": (r"[0-9]{3}\)?[ .-][0-9]{3}",
              r"(?:\G|(?<![0-9A-Za-z.+-]))\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,4}+(?![0-9A-Za-z]|[.-][0-9])"),
    "name": (r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}",
             rf"(?<![\p{{L}}-])(?:{_TITLE}{_FULL}|(?=\p{{Lu}})(?:{'|'.join(GIVEN_NAMES)})(?![\p{{L}}-])"
             rf"(?: \p{{Lu}}\p{{Ll}}+){{1,2}}+)"),
}
#: The regex labeler's form of a proposal, and the gazetteer's entries for all
#: spans of the kind (patterns on the span).
_FORM = {
    "email": r"[\[({](?:at|dot)[\])}]",
    "ip": r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|::",
    "phone": r"^(?:\([0-9]{3}\) |[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}$",
    "name": "^" + _TITLE,
}
_LISTED = {
    "email": r"(?i)[^A-Za-z0-9](?:com|org|net|edu|gov|info|io|eu|de|at|ch|fr|es|uk|us|it|nl|mx|ar)$",
    "ip": r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?i:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}\)?[ .-]|^\(?0[1-9]",
    "name": rf"^(?:{_TITLE})?(?:{'|'.join(GIVEN_NAMES)}) ",
}
#: Cue words before a span, lower case.
_CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write", "correo", "courriel", "address", "to"),
    "ip": ("ip", "host", "server", "address", "client", "from", "gateway", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "tarjeta", "carte", "karte", "number"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "cell", "at"),
    "name": ("name", "mr", "mrs", "dr", "by", "dear", "from", "signed", "regards", "von", "par", "por"),
}
BUCKETS = 512
FEATURES = 8
VOTES = 3
ROUNDS = 30
_BLOCK = 256
_FILL = "￼"  # stands for a character of a base span: part of no pattern
_SPAN = "array<struct<start:int,stop:int,hit:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(steps: Column) -> Column:
    """Running sums of an array of lengths: sums of blocks first, then sums
    inside a block, so no step copies a growing array of all matches."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
                         lambda b: add(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = F.aggregate(blocks, F.array(F.lit(0)),
                         lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    part = lambda i: F.floor(i / _BLOCK).cast("int")
    return let(before, lambda b: F.transform(steps, lambda _, i: F.get(b, part(i)) + add(
        F.slice(steps, part(i) * _BLOCK + 1, i - part(i) * _BLOCK + 1))))


def located(text: Column, pattern: Column) -> Column:
    """All matches of a pattern: start and stop in code points, the match, and
    up to 48 characters of the gaps before and after it."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"),
                     F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))

    def spans(s):
        steps = F.transform(s["hits"], lambda h, i: F.char_length(F.get(s["gaps"], i)) + F.char_length(h))
        return let(let(steps, _ends), lambda e: F.transform(s["hits"], lambda h, i: F.struct(
            (F.get(e, i) - F.char_length(h)).alias("start"), F.get(e, i).alias("stop"), h.alias("hit"),
            F.substring(F.get(s["gaps"], i), -48, 48).alias("before"),
            F.substring(F.get(s["gaps"], i + 1), 1, 48).alias("after"))))
    return let(found, lambda s: F.when(F.size(s["hits"]) == 0, F.array().cast(_SPAN)).otherwise(spans(s)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, F.lit("[^0-9]"), F.lit(""))


def luhn(digits: Column) -> Column:
    """The check sum of a string of 13 to 19 digits; false for other lengths."""
    n = F.char_length(digits)

    def worth(i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _holds(kind: Column, hit: Column) -> Column:
    """The test of a strict match."""
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (F.when(kind == KINDS.index("ip"), hit.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == KINDS.index("card"), luhn(_digits(hit)))
            .when(kind == KINDS.index("phone"), F.char_length(_digits(hit)).between(9, 15))
            .otherwise(True))


def _rules(base: bool) -> Column:
    """The strict or the loose patterns as an array of rows, so one expression
    serves all kinds."""
    def row(kind):
        hint, pattern = (_HINT[kind], STRICT[kind]) if base else LOOSE[kind]
        texts = {"hint": hint, "pattern": pattern, "form": _FORM.get(kind, ""), "listed": _LISTED[kind]}
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"),
                        *[F.lit(v).alias(c) for c, v in texts.items()],
                        F.array(*[F.lit(c) for c in _CUES[kind]]).alias("cues"))
    return F.array(*[row(k) for k in (BASE if base else KINDS)])


def _hinted(text: Column, base: bool) -> Column:
    return F.filter(_rules(base), lambda r: F.rlike(text, r["hint"]))


def _masked(text: Column) -> Column:
    """The text with its base spans filled, of the same length."""
    def fill(rule):
        return lambda h: F.when(_holds(rule["kind"], h), F.repeat(F.lit(_FILL), F.char_length(h))).otherwise(h)

    def one(t, rule):
        found = F.struct(F.split(t, rule["pattern"], -1).alias("gaps"),
                         F.transform(F.regexp_extract_all(t, rule["pattern"], F.lit(0)), fill(rule)).alias("hits"))
        return let(found, lambda s: F.array_join(F.transform(s["gaps"], lambda g, i: F.concat(
            g, F.coalesce(F.get(s["hits"], i), F.lit("")))), ""))
    return F.aggregate(_hinted(text, True), text, one)


def _words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}-]+"), F.lit(0))


def _shape(hit: Column) -> Column:
    for pattern, mark in ((r"[0-9]+", "9"), (r"\p{Lu}+", "A"), (r"[\p{Ll}]+", "a")):
        hit = F.regexp_replace(hit, F.lit(pattern), F.lit(mark))
    return hit


def _candidate(rule: Column, span: Column) -> Column:
    """A span with the three votes and its features (bucket by position)."""
    hit = span["hit"]
    form = (F.when(rule["base"], True).when(rule["kind"] == KINDS.index("card"), luhn(_digits(hit)))
            .otherwise(F.rlike(hit, rule["form"])))

    def build(words):
        near = F.slice(words, F.greatest(F.size(words) - 3, F.lit(0)) + 1, F.lit(4))
        votes = F.array(*[v.cast("int") for v in (
            form, F.rlike(hit, rule["listed"]), F.arrays_overlap(near, rule["cues"]))])
        told = F.array(F.element_at(words, -1), F.when(F.size(words) > 1, F.element_at(words, -2)),
                       F.get(_words(span["after"]), F.lit(0)), _shape(hit), F.char_length(hit).cast("string"))
        hashed = F.transform(told, lambda t: F.pmod(
            F.xxhash64(F.coalesce(t, F.lit(""))), F.lit(BUCKETS)).cast("int"))
        return let(votes, lambda v: F.struct(
            rule["kind"].alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
            rule["base"].alias("base"), v.alias("votes"), F.concat(v, hashed).alias("features")))
    # An empty array has no last element: one empty word stands before all.
    return let(F.concat(F.array(F.lit("")), _words(span["before"])), build)


def _found(text: Column, base: bool) -> Column:
    def of(rule):
        spans = located(text, rule["pattern"])
        if base:
            spans = F.filter(spans, lambda s: _holds(rule["kind"], s["hit"]))
        return F.transform(spans, lambda s: _candidate(rule, s))
    return F.flatten(F.transform(_hinted(text, base), of))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): the base spans and proposals of each row, with votes
    and features."""
    text = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"))
    rows = rows.select("*", _found(F.col("text"), True).alias("strict"))
    left = F.when(F.size("strict") > 0, _masked(F.col("text"))).otherwise(F.col("text"))
    return rows.select("doc_id", "strict", left.alias("text")).select(
        "doc_id", F.concat("strict", _found(F.col("text"), False)).alias("spans"))


# ---------------------------------------------------------------------------
# The label model and the classifier

def _likelihood(votes: Column, rates: Column) -> Column:
    return F.aggregate(F.zip_with(votes, rates, lambda v, r: F.when(v == 1, r).otherwise(1 - r)),
                       F.lit(1.0), lambda a, x: a * x)


def _posterior(votes: Column, model: Column) -> Column:
    yes = model["share"] * _likelihood(votes, model["hit"])
    no = (1 - model["share"]) * _likelihood(votes, model["miss"])
    return yes / (yes + no)


def _maximised(patterns: Column, model: Column) -> Column:
    """One round: expected labels of the vote patterns, then the model that
    fits them.  Small counts keep the labelers better than chance."""
    soft = F.transform(patterns, lambda p: F.struct(
        p["votes"].alias("votes"), (p["n"] * _posterior(p["votes"], model)).alias("yes"),
        p["n"].cast("double").alias("n")))

    def fitted(s):
        add = lambda f: F.aggregate(s, F.lit(0.0), lambda a, p: a + f(p))
        rate = lambda of, v, a, b: (add(lambda p: F.when(
            F.get(p["votes"], F.lit(v)) == 1, of(p)).otherwise(0.0)) + a) / (add(of) + a + b)
        yes, no = (lambda p: p["yes"]), (lambda p: p["n"] - p["yes"])
        return F.struct(((add(yes) + 1.0) / (add(lambda p: p["n"]) + 2.0)).alias("share"),
                        F.array(*[rate(yes, v, 8.0, 2.0) for v in range(VOTES)]).alias("hit"),
                        F.array(*[rate(no, v, 1.0, 9.0) for v in range(VOTES)]).alias("miss"))
    return let(soft, fitted)


def label_model(found: DataFrame) -> DataFrame:
    """(kind, votes, n, posterior, share, hit, miss): for each kind and vote
    pattern how likely a span is true; ``hit`` and ``miss`` are the rates at
    which each labeler votes for true and for false spans."""
    patterns = (found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes")
                .agg(F.count("*").alias("n")).groupBy("kind")
                .agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns")))
    start = F.struct(F.lit(0.5).alias("share"), F.array(*[F.lit(0.8)] * VOTES).alias("hit"),
                     F.array(*[F.lit(0.1)] * VOTES).alias("miss"))
    model = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start,
                        lambda m, _: _maximised(F.col("patterns"), m))
    fitted = patterns.withColumn("model", model)
    return fitted.select("kind", "model", F.explode("patterns").alias("p")).select(
        "kind", "p.votes", "p.n", _posterior(F.col("p.votes"), F.col("model")).alias("posterior"), "model.*")


def span_classifier(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(kind, offset, weight) of the naive Bayes classifier on soft labels: the
    log odds of value ``offset % BUCKETS`` of feature ``offset / BUCKETS``, or
    of the kind itself (offset -1)."""
    # Whole millionths: their sums do not depend on the order of rows.
    yes = F.round(F.col("posterior") * 1_000_000).cast("long")
    soft = labels.select("kind", "votes", yes.alias("yes"), (F.lit(1_000_000) - yes).alias("no"))
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    # At most kinds x 8 rows.
    each = spans.join(F.broadcast(soft), ["kind", "votes"]).select(
        "kind", "yes", "no", F.posexplode(F.concat(F.array(F.lit(-1)), "features")).alias("at", "value"))
    seen = each.groupBy("kind", "at", "value").agg(
        (F.sum("yes") / 1e6).alias("yes"), (F.sum("no") / 1e6).alias("no"))
    totals = seen.where("at = 0").select("kind", F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    grid = totals.select("*", F.explode(F.sequence(F.lit(-1), F.lit(FEATURES * BUCKETS - 1))).alias("offset"))
    counts = seen.where("at > 0").select("kind", "yes", "no", (
        (F.col("at") - 1) * BUCKETS + F.col("value")).alias("offset"))
    sizes = F.when(F.col("offset") < VOTES * BUCKETS, F.lit(2.0)).otherwise(F.lit(float(BUCKETS)))
    share = lambda n, of: (F.coalesce(n, F.lit(0.0)) + 0.1) / (F.col(of) + 0.1 * sizes)
    weight = F.when(F.col("offset") < 0, F.ln((F.col("all_yes") + 0.5) / (F.col("all_no") + 0.5))).otherwise(
        F.ln(share(F.col("yes"), "all_yes") / share(F.col("no"), "all_no")))
    return grid.join(counts, ["kind", "offset"], "left").select("kind", "offset", weight.alias("weight"))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of each row: (kind, start, stop, base, odds), by kind
    and start; ``odds`` are the log odds of an added span."""
    found = stage(candidates(docs, doc_id, text), "pii_spans")
    labels = stage(label_model(found), "pii_labels")
    weights = stage(span_classifier(found, labels), "pii_weights")
    # One row: for each kind FEATURES x BUCKETS weights after that of the kind itself.
    table = weights.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("offset", "weight")))["weight"]
                                        .alias("w"))
    model = table.agg(F.map_from_entries(F.collect_list(F.struct("kind", "w"))).alias("m")).scalar()

    def odds(s):
        w = lambda at: F.get(F.element_at(F.col("model"), s["kind"]), at)
        return F.aggregate(F.transform(s["features"], lambda x, i: w(i * BUCKETS + x + 1)), w(F.lit(0)),
                           lambda a, x: a + x)
    judged = F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"),
        F.when(~s["base"], odds(s)).alias("odds")))
    kept = F.filter(judged, lambda s: s["base"] | (s["odds"] > 0))
    return found.withColumn("model", model).select("doc_id", F.sort_array(kept).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")


def base_spans(spans: Column, kind: str | None = None) -> Column:
    of = lambda s: s["base"] if kind is None else s["base"] & (s["kind"] == KINDS.index(kind))
    return F.filter(spans, of)
