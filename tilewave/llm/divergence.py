"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into hash stripes: for each language and term, the number of documents that hold it and its
occurrences by source. When a partition holds `max_cells` cells (source counts of terms) it spills: its stripes go out, and new
ones begin. The spilled stripes are dealt out and sorted by (language, term), and those of one key are merged as they stream past.
A key has at most one stripe for each spill, so that a term of every document is as light as any other.

Terms in at least `min_docs` documents of their language are kept; the merged stripes of kept terms are written once. Their sums by
source give each group's total, and then each block of stripes emits the divergences directly: for each two sources of a language
the sum of the absolute differences of their smoothed shares, and for each source the `top` terms of that block whose share there
exceeds that of the language.

A share is 1 + floor(10^9 (count + 5) / (N + 5 V)), with N the counts' sum over the V kept terms, by long division in base 1000, so
that all is exact while N + 5 V is under 9 * 10^15.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Edge cases: null texts, languages and sources count as
''. A group without terms has pairs, a language without kept terms pairs of value 0, a language of one source no pair. Repeated
rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewave.llm.common import Scratch

MAX_CELLS = 1 << 20
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
SCALE = 10**9
SALTS = 64
#: Matrix cells (terms x sources) that a block of stripes takes at a time.
BLOCK = 1 << 21

Stripes = dict[str, dict[bytes, list]]


def spilled(stripes: Stripes) -> Iterator[pa.RecordBatch]:
    for lang, terms in stripes.items():
        keys = list(terms)
        for k in range(0, len(keys), 20_000):
            part = keys[k : k + 20_000]
            own = [terms[t] for t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array([t.decode() for t in part], pa.string()), pa.array([s[0] for s in own], pa.int64()), pa.array([list(s[1]) for s in own], pa.list_(pa.string())), pa.array([list(s[1].values()) for s in own], pa.list_(pa.int64()))],
                schema=_ARROW,
            )


def folded(batches: Iterator[pa.RecordBatch], max_cells: int = MAX_CELLS) -> Iterator[pa.RecordBatch]:
    stripes: Stripes = {}
    cells = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            terms = stripes.setdefault(lang, {})
            for term, n in Counter(text.as_py().translate(_TERM).split()).items():
                if (stripe := terms.get(term)) is None:
                    terms[term] = [1, {source: n}]
                    cells += 1
                else:
                    stripe[0] += 1
                    if source in stripe[1]:
                        stripe[1][source] += n
                    else:
                        stripe[1][source] = n
                        cells += 1
            if cells >= max_cells:
                yield from spilled(stripes)
                stripes, cells = {}, 0
    yield from spilled(stripes)


def merged(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by (lang, term) -> one for each kept term. The last key of a batch waits for what the next one has of it."""
    key, df, sums = None, 0, {}
    rows: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, term, _, sources, counts = batch.columns
        changes = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        begin = np.r_[0, np.flatnonzero(changes) + 1]
        each = np.add.reduceat(batch.column(2).to_numpy(), begin)
        stop = np.r_[begin[1:], batch.num_rows]
        first = (lang[0].as_py(), term[0].as_py())
        if first != key:
            if key and df >= min_docs:
                rows.append((*key, df, list(sums), list(sums.values())))
            key, df, sums = first, 0, {}
        for k in np.union1d(np.flatnonzero(each >= min_docs), [0, len(begin) - 1]).tolist():
            if k:
                if df >= min_docs:
                    rows.append((*key, df, list(sums), list(sums.values())))
                key, df, sums = (lang[int(begin[k])].as_py(), term[int(begin[k])].as_py()), 0, {}
            df += int(each[k])
            part = slice(int(begin[k]), int(stop[k]))
            for s, c in zip(sources[part].flatten().to_pylist(), counts[part].flatten().to_pylist()):
                sums[s] = sums.get(s, 0) + c
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
            rows.clear()
    if key and df >= min_docs:
        rows.append((*key, df, list(sums), list(sums.values())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 5) / totals), exact: totals is N + 5 V."""
    out, rest = np.divmod(counts + 5, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


def emitted(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value): partial sums of pairs, and the top terms of each group in this partition."""
    pairs: dict[str, np.ndarray] = {}
    names: dict[str, list[str]] = {}
    best: dict[tuple[str, str], list[tuple[int, str]]] = {}

    def block(lang: str, sources: list[str], ns: list[int], v: int, rows: pa.RecordBatch) -> None:
        own = rows.column("sources")
        counts = np.zeros((rows.num_rows, len(sources) + 1), np.int64)
        counts[np.repeat(np.arange(rows.num_rows), pc.list_value_length(own).to_numpy()), pc.index_in(own.flatten(), pa.array(sources)).to_numpy()] = rows.column("counts").flatten().to_numpy()
        counts[:, -1] = counts.sum(axis=1)
        p = shares(counts, np.array([*ns, sum(ns)], np.int64) + 5 * v)
        sums = pairs.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
        names[lang] = sources
        for a in range(len(sources) - 1):
            sums[a, a + 1 :] += np.abs(p[:, a + 1 : -1] - p[:, a : a + 1]).sum(axis=0)
        above = np.where(counts[:, :-1] > 0, p[:, :-1] - p[:, -1:], 0)
        terms = rows.column("term")
        for a, source in enumerate(sources):
            value = above[:, a]
            at = np.flatnonzero(value > 0)
            if len(at) > top:  # the top by value, and all that tie with the last of them
                at = at[value[at] >= np.partition(value[at], len(at) - top)[len(at) - top]]
            own = best.setdefault((lang, source), [])
            own += [(-int(value[k]), terms[int(k)].as_py()) for k in at]
            own.sort(key=lambda x: (x[0], x[1].encode()))
            del own[top:]

    for batch in batches:
        for lang in batch.column("lang").unique().to_pylist():
            own = batch.filter(pc.equal(batch.column("lang"), lang))
            sources, ns, v = (own.column(c)[0].as_py() for c in ("of", "ns", "v"))
            step = max(1, BLOCK // (len(sources) + 1))
            for k in range(0, own.num_rows, step):
                block(lang, sources, ns, v, own.slice(k, step))
    out: list[tuple] = []
    for lang, sums in pairs.items():
        both = sums + sums.T
        out += [(lang, a, "pair", b, int(both[i, j])) for i, a in enumerate(names[lang]) for j, b in enumerate(names[lang]) if i != j]
    for (lang, source), terms in best.items():
        out += [(lang, source, "term", term, -value) for value, term in terms]
    for k in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 4 else pa.string()) for i, c in enumerate(zip(*out[k : k + 50_000]))], ["lang", "source", "part", "item", "value"])


def stripes_of(docs: DataFrame, min_docs: int, max_cells: int = MAX_CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """STRIPE: the merged stripes of the kept terms."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spills = own.mapInArrow(lambda batches: folded(batches, max_cells), STRIPE)
    by_key = spills.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return by_key.mapInArrow(lambda batches: merged(batches, min_docs), STRIPE)


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, max_cells: int = MAX_CELLS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the language and the distance to it, part `term`
    the terms that the source uses more than its language does."""
    scratch = Scratch()
    kept = scratch(stripes_of(docs, min_docs, max_cells, text_col, lang_col, source_col), "stripes")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = scratch(groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g")).join(terms, "lang")
    # a language may have most of the terms: its totals stand once for each of SALTS shares of them
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    totals = by_lang.select("lang", F.col("g.source").alias("of"), F.col("g.n").alias("ns"), "v", salts)
    wide = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"), "term", "sources", "counts").join(totals, ["lang", "salt"]).drop("salt")
    parts = wide.mapInArrow(lambda batches: emitted(batches, top), "lang string, source string, part string, item string, value long")
    parts = scratch(parts, "divergences")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source != item")
    found = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.select("*", F.row_number().over(order).alias("rank")) for x in (pairs, parts.where("part = 'term'").select("lang", "source", "part", "item", "value"))]
    out = ranked[0].unionAll(ranked[1].where(F.col("rank") <= top))
    out = scratch(out, "divergence")
    scratch.drop(out)
    return out


#: The same for DuckDB over the view documents.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
  FROM gn g JOIN kept t USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (lc.n + 5)) // (s.total + 5 * v.v) AS q
  FROM lc JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM lc GROUP BY lang) s USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
