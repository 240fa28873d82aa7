"""Personal data by weak supervision.

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers. Looser patterns add
candidates: national phone numbers, spelt-out e-mail addresses, social security numbers and bank accounts (IBAN).
On every span, base or candidate, three labelers vote: the strict pattern of its kind, a gazetteer
(domain endings, area codes, issuing ranges, countries), and the words before it. Expectation-maximisation over the
counts of vote patterns, of all documents, estimates each labeler's reliability for each kind; its posteriors are the
soft labels of a log-linear span classifier on the votes and the span's shape. Candidates that the
classifier accepts are added to the base spans, unless they overlap one.

Only counts by vote pattern and shape, whose number is fixed, reach the driver. Texts are read once:
the spans are stored, and counted and judged from there.

Edge cases: a null or empty text has no spans. Positions are code points, ends exclusive. Repeated
rows give repeated results, an empty table an empty one. Extra columns are ignored. The patterns are
possessive or bounded, and places are summed up in stretches, so that neither very long runs nor very many matches in
a text take quadratic time or stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewave.llm.common import let, stored

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns. Look-behinds say where a leftmost match can begin; \G lets one begin where the last ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])(?=(?:[0-9][ -]?){13}[0-9])[0-9](?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What any text with a match must hold.
NEEDS = {"email": "@", "phone": "+"}
#: Candidate patterns.
LOOSE = {
    "phone": r"(?<![0-9+(.-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|server|host|address|adresse|dirección|login",
    "card": "card|visa|master|amex|karte|carte|tarjeta|pay",
    "phone": "phone|call|tel|fax|mobile|cell|contact|anruf|appel|llam",
    "ssn": "ssn|social|security|tax|steuer",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
AGAINST = "version|isbn|order|ref|invoice|serial|part no"
ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz"
COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,text:string,before:string,after:string>>"
#: Characters before a span that labelers see, and values that a fold runs over at once.
NEAR, CHUNK = 32, 128


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((n - i) % 2 == 0, F.substring(number, i, F.lit(1)).try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(number, i, F.lit(1)).try_cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = digits(text)
        return F.length(d).between(14, 19) & luhn(F.substring(d, 1, 19))
    if kind == "phone":
        return F.length(digits(text)).between(10, 15)
    return F.lit(True)


def scan(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place what step makes of the values before it. Folds run over stretches of CHUNK values and then over
    the stretches, as a fold copies what it has put out so far at each step."""

    def fold(part: Column, begin: Column) -> Column:
        none = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, none, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def parted(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(v, i, F.lit(CHUNK)))

    def whole(parts: Column) -> Column:
        begins = fold(F.transform(parts, lambda part: F.aggregate(part, start, step)), start)
        return F.flatten(F.zip_with(parts, begins, fold))

    return let(let(values, parted), whole)


def spans_of(text: Column, kind: str, pattern: str, need: Column) -> Column:
    """Leftmost non-overlapping matches with their places, up to NEAR characters before them and the one after.

    What lies between the matches is counted along. Nothing is cut out of the whole text at a place, as that takes longer
    the further on the place is.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind) if kind in KINDS else len(KINDS)

    def end(x: Column) -> Column:
        return F.substring(x, -NEAR, NEAR)

    def placed(v: Column) -> Column:
        f, b = v["found"], v["between"]
        offsets = scan(F.zip_with(F.slice(b, F.lit(1), F.size(f)), f, lambda x, y: F.length(x) + F.length(y)), F.lit(0), lambda at, n: at + n)
        ends = F.zip_with(F.slice(b, F.lit(1), F.size(f)), f, lambda x, y: end(F.concat(end(x), end(y))))

        def spans(w: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                begin = F.get(w["offsets"], i) + F.length(F.get(b, i))
                # a match has 5 characters at least, so that seven more pieces hold NEAR of them
                before = end(F.concat(*[F.coalesce(F.get(w["ends"], i - k), F.lit("")) for k in range(7, 0, -1)], end(F.get(b, i))))
                after = F.substring(F.concat(F.substring(F.get(b, i + 1), 1, 1), F.substring(F.coalesce(F.get(f, i + 1), F.lit("")), 1, 1)), 1, 1)
                return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(x)).alias("stop"), F.lit(kind).alias("kind"), x.alias("text"), before.alias("before"), after.alias("after"))

            return F.transform(f, span)

        return let(F.struct(offsets.alias("offsets"), ends.alias("ends")), spans)

    pieces = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(need, let(pieces, placed)).otherwise(F.array().cast(SPAN))


def clear_of(loose: Column, base: Column) -> Column:
    """The loose spans that no base span overlaps: both are put in order, and the base spans' largest end so far and
    smallest start to come are carried along."""
    far = F.lit(2**31 - 1)

    def swept(events: Column) -> Column:
        def judged(w: Column) -> Column:
            free = F.zip_with(events, F.arrays_zip(w["ended"].alias("ended"), F.reverse(w["begins"]).alias("begins")), lambda e, x: F.struct(e.alias("e"), ((x["ended"] <= e["start"]) & (x["begins"] >= e["span"]["stop"])).alias("free")))
            return F.transform(F.filter(free, lambda x: x["free"] & ~x["e"]["base"]), lambda x: x["e"]["span"])

        ended = scan(F.transform(events, lambda e: F.when(e["base"], e["span"]["stop"]).otherwise(0)), F.lit(0), lambda at, x: F.greatest(at, x))
        begins = scan(F.reverse(F.transform(events, lambda e: F.when(e["base"], e["start"]).otherwise(far))), far, lambda at, x: F.least(at, x))
        return let(F.struct(ended.alias("ended"), begins.alias("begins")), judged)

    def events(spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(is_base).alias("base"), s.alias("span")))

    both = F.array_sort(F.concat(events(base, True), events(loose, False)))
    return F.when((F.size(base) > 0) & (F.size(loose) > 0), let(both, swept)).otherwise(loose)


def _votes(span: Column, base: bool) -> Column:
    """The span with its labelers' votes (1 for, 0 against, -1 none) and its shape."""
    kind, match, before, after = span["kind"], span["text"], F.lower(span["before"]), span["after"]

    def by_kind(of: dict[str, Column], other: Column) -> Column:
        return reduce(lambda rest, k: F.when(kind == k, of[k]).otherwise(rest), of, other)

    cue = by_kind({k: before.rlike(rf"\b(?:{v})") for k, v in CUES.items()}, F.lit(False))
    context = F.when(cue, 1).when(before.rlike(rf"\b(?:{AGAINST})"), 0).otherwise(-1)
    number = digits(match)
    gazetteer = by_kind(
        {
            "email": F.when(match.rlike(rf"(?i)(?:{ENDINGS})$"), 1).otherwise(0),
            "ip": F.when(match.rlike(r"^(?:0|127|255)\."), 0).otherwise(-1),
            "card": F.when(match.rlike("^(?:3[47]|4|5[1-5]|6)"), 1).otherwise(0),
            "phone": F.when(F.substring(number, -10, 10).rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(0),
            "ssn": F.when(match.rlike("^(?:000|666|9)"), 0).otherwise(1),
            "iban": F.when(match.rlike(f"^(?:{COUNTRIES})"), 1).otherwise(0),
        },
        F.lit(-1),
    )
    length = F.length(match)
    shape = F.concat_ws("", F.when(length < 12, "s").when(length < 20, "m").otherwise("l"), F.when(after.rlike(r"^[\p{L}\p{N}_]"), "w").when(after == "", "e").otherwise("o"))
    return F.struct(*[span[c].alias(c) for c in ("start", "rank", "stop", "kind")], F.lit(1 if base else 0).alias("pattern"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"))


def _valid_span(kind: str) -> Callable[[Column], Column]:
    return lambda span: valid(kind, span["text"])


def _voter(base: bool) -> Callable[[Column], Column]:
    return lambda span: _votes(span, base)


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, loose: spans with votes and shape, by start and kind."""
    text = F.col("text")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("digit", text.rlike("[0-9]"))
    needs = {k: text.contains(NEEDS[k]) & F.col("digit") if k == "phone" else text.contains(NEEDS[k]) if k in NEEDS else F.col("digit") for k in BASE}
    own = own.withColumns({k: spans_of(text, k, p, needs[k]) for k, p in BASE.items()})
    loose_needs = {"email": text.rlike(r"[\[(]at[\])]")}
    own = own.withColumns({f"loose_{k}": spans_of(text, k, p, loose_needs.get(k, F.col("digit"))) for k, p in LOOSE.items()})
    base = F.concat(*[F.filter(F.col(k), _valid_span(k)) for k in BASE])
    own = own.select("doc_id", base.alias("base"), F.concat(*[F.col(f"loose_{k}") for k in LOOSE]).alias("loose"))
    own = own.withColumn("loose", clear_of(F.col("loose"), F.col("base")))
    marked = [F.array_sort(F.transform(c, _voter(c == "base"))).alias(c) for c in ("base", "loose")]
    return own.select("doc_id", *marked)


VOTES = ("pattern", "gazetteer", "context")


def reliabilities(rows: list, rounds: int = 50, prior: float = 0.7) -> tuple[dict, dict]:
    """EM over counts. rows: (kind, pattern, gazetteer, context, shape, n). Returns each kind's share of true spans and
    P(vote | truth, kind, labeler), with one added to each count so that a labeler without votes stays neutral."""
    kinds = {r.kind for r in rows}
    share = dict.fromkeys(kinds, prior)
    good = {(k, v): {True: {1: 0.7, 0: 0.1, -1: 0.2}, False: {1: 0.2, 0: 0.5, -1: 0.3}} for k in kinds for v in VOTES}

    def posterior(r) -> float:
        yes, no = math.log(share[r.kind]), math.log(1 - share[r.kind])
        for v in VOTES:
            yes += math.log(good[r.kind, v][True][r[v]])
            no += math.log(good[r.kind, v][False][r[v]])
        return 1 / (1 + math.exp(min(50, no - yes)))

    for _ in range(rounds):
        p = [posterior(r) for r in rows]
        for k in kinds:
            mine = [(r, q) for r, q in zip(rows, p) if r.kind == k]
            n, t = sum(r.n for r, _ in mine), sum(r.n * q for r, q in mine)
            share[k] = min(0.99, max(0.01, (t + 7) / (n + 10)))
            for v in VOTES:
                for truth in (True, False):
                    # pseudo-counts pull towards the start values, so that truth keeps its meaning
                    start = {1: 7.0, 0: 1.0, -1: 2.0} if truth else {1: 2.0, 0: 5.0, -1: 3.0}
                    count = {x: start[x] + sum(r.n * (q if truth else 1 - q) for r, q in mine if r[v] == x) for x in (1, 0, -1)}
                    total = sum(count.values())
                    good[k, v][truth] = {x: c / total for x, c in count.items()}
    return share, {r: posterior(r) for r in rows}


def classifier(rows: list) -> dict[tuple[str, str, str], float]:
    """Log-odds of (kind, feature, value), fitted to EM's posteriors; feature "" has the prior."""
    _, soft = reliabilities(rows)
    out: dict[tuple[str, str, str], float] = {}
    for k in {r.kind for r in rows}:
        mine = [(r, q) for r, q in soft.items() if r.kind == k]
        yes, no = sum(r.n * q for r, q in mine) + 1, sum(r.n * (1 - q) for r, q in mine) + 1
        out[k, "", ""] = math.log(yes / no)
        for f in (*VOTES, "shape"):
            values = {str(r[f]) for r, _ in mine}
            for x in values:
                a = sum(r.n * q for r, q in mine if str(r[f]) == x) + 1
                b = sum(r.n * (1 - q) for r, q in mine if str(r[f]) == x) + 1
                out[k, f, x] = math.log(a / (yes + len(values))) - math.log(b / (no + len(values)))
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: spans (start, rank, stop, kind), sorted."""
    found = stored(found_spans(docs, id_col, text_col), "pii")
    every = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    # kinds x votes x shapes: at most a few thousand rows whatever the documents
    rows = every.groupBy("s.kind", "s.pattern", "s.gazetteer", "s.context", "s.shape").agg(F.count("*").alias("n")).collect()
    weights = classifier(rows)

    def odds(s: Column) -> Column:
        total = F.lit(0.0)
        for f in ("", *VOTES, "shape"):
            part = F.lit(0.0)
            for (k, g, x), w in sorted(weights.items()):
                if g == f:
                    fits = (s["kind"] == k) & (s[f].cast("string") == x) if f else s["kind"] == k
                    part = F.when(fits, F.lit(w)).otherwise(part)
            total = total + part
        return total

    added = F.filter("loose", lambda s: odds(s) > 0)
    return found.select("doc_id", "base", added.alias("added"))


def pii_digest(docs: DataFrame) -> DataFrame:
    spans = pii_spans(docs)

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
