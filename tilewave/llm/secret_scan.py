"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of characters that keys and tokens are made of: of at least `min_chars` if letters and digits are
mixed, of at least `long_chars` otherwise. A forest judges each by its length, the transitions between its
character classes and between its letters, the share of its four-letter windows that the corpus's words are made of,
whether it looks like part of a path or address, and the words beside it.

The forest is trained from labelled findings: `labelled`, or else findings whose value alone tells (`format_label`: keys of
known issuers are secrets; runs of letters, UUIDs and dates are none; the rest has no label), and in either case `built_rows` built
ones: a corpus may hold no value of digits that is harmless, so that UUIDs, digests of commits, files and links, builds, orders, versions
and product names stand beside passwords, tokens and keys of several alphabets, each in the surroundings that tell them apart (`built`). The forest
sees neither formats nor which characters a value holds, so it learns how such values move and what stands beside them, and
judges the unlabelled ones by that. At most `sample_rows` findings are used, the first by a hash of document and place.
All is DataFrame functions and JVM trees.

Edge cases: a null or empty text has no candidates. Places are code points, ends exclusive. If the labelled
findings are of one kind only (built_rows 0), the formats alone decide. Repeated rows give repeated results, an empty
table an empty one. Extra columns are ignored. Very long runs are one candidate each, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.llm.common import stored, text_of
from tilewave.llm.pii import spans_of

NAMES = "token|secret|passw|pwd|api.?key|apikey|auth|bearer|credential|private.?key|access.?key|signature"
ADDRESS = r"://|www\.|@|\.(?:com|org|net|html?|png|jpg)"
#: Values that tell by themselves.
FORMATS = "^(?:AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{30,})$"
HARMLESS = "^(?:[A-Za-z_/-]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2})?)$"
#: Templates of built findings, by label: {h} hexadecimal digits, {b} letters and digits of both cases, {u} a UUID, {d} digits, {A} capitals and
#: digits, {w} a word. A number behind the letter is how many.
BUILT = {
    0.0: ("request id {u} was served", "id={u}", "trace {u} ended", "commit {h40} by {w5}", "merged {h7}{h5} into main", "sha256:{h64}", "md5 {h32}", "checksum {h64} of {w6}", "https://cdn.example.com/assets/{w5}-{h20}.js", "https://example.org/{w6}/{h32}/view", "/usr/lib/{w7}/{h12}/{w4}", "build-{d8}-{d4} of {w5}", "release v{d1}-{d2}-{w3}{d1}", "order ORD-{d4}-{d6} came", "invoice INV{d8}", "the {w6}{d3} and {w5}{d2}", "{w5}-{d4}-{w4} for sale", "{w4}_{d2}_{w6}.png", "see {w7}{d4} there", "x{d10}y{d6}", "a {w7}{d1} here", "{w8}{d1} and {w9}{d2}", "{w5}{d1}{w4}", "{w8}{d3} or {w4}{d4}{w5}", "x" * 60, "a" * 1100, "-" * 40, "=" * 80),
    1.0: ("password={b14}", "password = {b10}", "pwd: {b12}", "token = \"{h40}\"", "token: {b32}", "secret = \"{h28}\"", "secret_key={b24}", "api_key: {b32}", "apikey=\"{h32}\"", "auth token {b36}", "bearer {b40}", "credential = {A20}", "access_key = \"{A20}\"", "AKIA{A16}", "key AKIA{A16} in use", "ghp_{b36}", "xoxb-{d10}-{b20}", "sk_live_{b20}", "token = {u}", "passwd=\"{b9}{d2}\""),
}
WORD, FRAGMENT = "(?<![a-z])[a-z]{4,24}(?![a-z])", "(?=([a-z]{4}))"
FEATURES = ["length", "class_moves", "digit_moves", "vowel_moves", "coverage", "path", "named", "assigned", "quoted"]


def candidates(docs: DataFrame, min_chars: int = 8, long_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop, found, before, after: one row per candidate."""
    key = "[A-Za-z0-9+/_=-]"
    mixed = rf"(?={key}*?[0-9])(?={key}*?[A-Za-z]){key}{{{min_chars},}}+"
    pattern = rf"(?<!{key})(?:{mixed}|{key}{{{long_chars},}}+)"
    own = text_of(docs, id_col, text_col)
    text = F.col("text")
    found = own.select("doc_id", F.explode(spans_of(text, "secret", pattern, text.rlike(pattern))).alias("s"))
    return found.select("doc_id", "s.start", "s.stop", F.col("s.text").alias("found"), F.lower("s.before").alias("before"), F.col("s.after").alias("after"))


def _moves(text: Column, pair: str) -> Column:
    """Share of neighbours that a two-character look-ahead pattern describes."""
    return F.regexp_count(text, F.lit(f"(?=(?:{pair}))")) / F.greatest(F.length(text) - 1, F.lit(1))


def word_fragments(docs: DataFrame, min_docs: int = 3, share: float = 2e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fragment): the four-letter windows that make up `share` or more of those of the words in `min_docs` documents or more. At most 26**4."""
    words = text_of(docs, id_col, text_col).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    windows = stored(known.select(F.explode(F.regexp_extract_all("word", F.lit(FRAGMENT), F.lit(1))).alias("fragment")).groupBy("fragment").agg(F.count("*").alias("n")), "fragments")
    total = windows.agg(F.sum("n")).first()[0] or 0
    return windows.where(F.col("n") >= share * total).select("fragment")


def described(found: DataFrame, fragments: DataFrame) -> DataFrame:
    """The features of candidates."""
    s, before = F.col("found"), F.col("before")
    vowel, other = "[aeiouyAEIOUY]", "[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]"
    found = stored(found.withColumn("finding", F.monotonically_increasing_id()), "candidates")
    windows = found.select("finding", F.explode(F.regexp_extract_all(F.lower("found"), F.lit(FRAGMENT), F.lit(1))).alias("fragment"))
    covered = windows.join(F.broadcast(fragments), "fragment").groupBy("finding").agg(F.count("*").alias("covered"))
    return found.join(covered, "finding", "left").withColumns(
        {
            "length": F.least(F.length(s), F.lit(1024)).cast("double"),
            "class_moves": _moves(s, "[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]"),
            "digit_moves": _moves(s, "[0-9][0-9]"),
            "vowel_moves": _moves(s, f"{vowel}{other}|{other}{vowel}"),
            "coverage": F.coalesce("covered", F.lit(0)) / F.greatest(F.length(s) - 3, F.lit(1)),
            "path": (s.contains("/") | before.rlike(rf"(?:{ADDRESS})[^ \n]*$|/$")).cast("double"),
            # name and sign can be part of the run, as in password=...
            "named": (before.rlike(NAMES) | F.lower(s).rlike(NAMES)).cast("double"),
            "assigned": (before.rlike(r"[=:]\s*[\"']?$") | s.rlike("^[A-Za-z_-]+=[^=]")).cast("double"),
            "quoted": (before.rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        }
    )


def format_label() -> Column:
    """1, 0 or null for a candidate, by its value alone."""
    s = F.col("found")
    return F.when(s.rlike(FORMATS), 1.0).when(s.rlike(HARMLESS), 0.0)


def _word(digest: Column, known: Column | None, n: int) -> Column:
    if known is not None:
        return F.concat(*[F.get(known, F.conv(F.substring(digest, k, 6), 16, 10).cast("int") % n) for k in (1, 7, 13)])
    vowels = F.translate(digest, "0123456789abcdef", "aeiouaeioaeeiora")
    consonants = F.translate(digest, "0123456789abcdef", "bcdfglmnprstvkhs")
    return F.concat(*[F.concat(F.substring(consonants, k + 1, 1), F.substring(vowels, k + 40, 1)) for k in range(5)])


def built(spark: SparkSession, rows: int, pieces: Sequence[str] = (), seed: str = "built") -> DataFrame:
    """(doc_id, text, label): built findings, `rows` in all, made from the templates in turn and the digests of their numbers. Words are made of
    pieces, which are those of the corpus's own words, or of consonants and vowels in turn."""
    parts = []
    known = F.array(*map(F.lit, pieces)) if pieces else None
    for label, templates in BUILT.items():
        own = spark.range(rows // 2).withColumn("t", F.get(F.array(*map(F.lit, templates)), F.col("id").cast("int") % len(templates)))
        text = F.col("t")
        nth = 0
        for kind in ("u", "h", "b", "A", "d", "w"):
            for n in sorted({int(x or 0) for t in templates for x in re.findall(rf"\{{{kind}([0-9]*)\}}", t)}):
                nth += 1
                digest = F.sha2(F.concat_ws("|", F.lit(f"{seed}{label}{kind}{n}{nth}"), "id"), 512)
                wide = F.translate(F.base64(F.unhex(digest)), "+/=", "xyz")
                value = {
                    "u": F.concat_ws("-", *[F.substring(digest, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
                    "h": F.substring(digest, 1, n), "b": F.substring(wide, 1, n), "A": F.upper(F.substring(wide, 1, n)),
                    "d": F.translate(F.substring(digest, 1, n), "abcdef", "012345"),
                    "w": F.substring(_word(digest, known, len(pieces)), 1, n),
                }[kind]
                text = F.replace(text, F.lit("{" + kind + (str(n) if n else "") + "}"), value)
        parts.append(own.select((F.col("id") + int(label) * rows).alias("doc_id"), F.concat(F.lit("then "), text, F.lit(" again")).alias("text"), F.lit(label).alias("label")))
    return parts[0].unionAll(parts[1])


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, sample_rows: int = 20_000, built_rows: int = 4_000, trees: int = 20, depth: int = 6, min_chars: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per secret: doc_id, start, stop, score, sha256 of the string. labelled: (doc_id, start, stop, label)."""
    fragments = stored(word_fragments(docs, id_col=id_col, text_col=text_col), "known-fragments")
    found = stored(described(candidates(docs, min_chars, id_col=id_col, text_col=text_col), fragments), "findings")
    if labelled is None:
        marked = found.withColumn("label", format_label())
    else:
        marked = found.join(labelled.select("doc_id", "start", "stop", F.col("label").cast("double").alias("label")), ["doc_id", "start", "stop"])
    chosen = marked.where("label is not null").orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(sample_rows)
    pieces = [r.fragment for r in fragments.orderBy(F.xxhash64("fragment")).limit(200).collect()]
    own = built(docs.sparkSession, built_rows, pieces)
    more = described(candidates(own, min_chars), fragments).join(own.select("doc_id", "label"), "doc_id")
    train = stored(chosen.select(*FEATURES, "label").unionAll(more.select(*FEATURES, "label")), "labelled")
    kinds = {r.label for r in train.select("label").distinct().limit(2).collect()}
    if len(kinds) == 2:
        joined = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, probabilityCol="p", rawPredictionCol="raw", predictionCol="said").fit(joined.transform(train))
        scored = forest.transform(joined.transform(found)).withColumn("score", vector_to_array("p")[1])
    else:
        scored = found.withColumn("score", F.coalesce(format_label(), F.lit(0.0)))
    return scored.where(F.col("score") >= threshold).select("doc_id", "start", "stop", F.round("score", 6).alias("score"), F.sha2(F.col("found").cast("binary"), 256).alias("sha256"))
