"""How far apart the sources of each language are: a three-dimensional cube of cells.

Terms are counted by (lang, source) group. A cell is (block of groups, block of groups, block of terms): each group's
slice of a term block is copied to the cells of its row and column, a cell sums the differences of all its pairs over
its own terms, and the sums are added along the term axis. Terms that a cell's groups lack aren't stored: all of them
have one probability in a group, and enter once at the end. All arithmetic is in integers.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import NO_LETTER, long_cuts, materialize, pieces, shuffle_partitions, small_batches, text_bytes

#: Groups in a block of groups and terms in a block of terms, on average; they bound a cell's memory, not the result.
GROUPS, TERMS = 8, 4096
#: Documents of a language that must hold a term; what is added to each count; the scale of probabilities; terms listed per group.
LEAST_DOCS, ADDED, SCALE, LISTED = 30, 5, 10**9, 50
#: Bytes of text that are split at once; bytes of counts that a task gathers before it hands them on.
PIECE, GATHERED = 1 << 20, 1 << 23

#: Shuffle partitions that make one written part: a local file system starts processes for each part, which costs more than a small part's rows.
JOINED = 16

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _split(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """owner, term code and count of each (owner, term), and the terms by code, of texts that owner numbers."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(np.ascontiguousarray(data[offsets[0] : offsets[-1]]))]
    parts = pc.split_pattern_regex(pc.ascii_lower(pa.LargeStringArray.from_buffers(len(owner), buffers[1], buffers[2])), SEPARATORS)
    terms, whose = parts.flatten(), owner[pc.list_parent_indices(parts).to_numpy()]
    some = pc.not_equal(terms, "")
    coded = terms.filter(some).cast(pa.string()).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    keys, counts = np.unique(whose[some.to_numpy(zero_copy_only=False)] * n + coded.indices.to_numpy(), return_counts=True)
    return keys // n, keys % n, counts, coded.dictionary


def _by_group(batch_groups: np.ndarray, column) -> list[pa.Table]:
    """Tables (g, term, n, docs) of one batch: occurrences, and documents that hold the term."""
    data, offsets = text_bytes(column)
    out = []
    for at, to in pieces(offsets, PIECE):
        if offsets[to] - offsets[at] <= 2 * PIECE:
            whose, code, n, terms = _split(data, offsets[at : to + 1], np.arange(at, to))
            groups, docs = batch_groups[whose], np.ones(len(n), np.int64)
        else:  # one long text: its parts are counted one after the other, then together
            cuts = long_cuts(data, int(offsets[at]), int(offsets[to]), PIECE, NO_LETTER)
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                _, code, n, terms = _split(data, np.array([lo, hi]), np.zeros(1, np.int64))
                found.append(pa.table({"term": terms.take(pa.array(code)), "n": n}))
            whole = pa.concat_tables(found).group_by("term", use_threads=False).aggregate([("n", "sum")])
            terms = whole["term"].combine_chunks()
            n, code = whole["n_sum"].to_numpy(), np.arange(len(terms))
            groups, docs = np.full(len(n), batch_groups[at]), np.ones(len(n), np.int64)
        keys, place = np.unique(groups * max(len(terms), 1) + code, return_inverse=True)
        total = np.zeros((2, len(keys)), np.int64)
        np.add.at(total[0], place, n)
        np.add.at(total[1], place, docs)
        out.append(pa.table({"g": keys // max(len(terms), 1), "term": terms.take(pa.array(keys % max(len(terms), 1))), "n": total[0], "docs": total[1]}))
    return out


def _count(batches):
    number: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def handed():
        table = pa.concat_tables(held).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        names = list(number)
        at = table["g"].combine_chunks()
        pair = [pa.array([x[k] for x in names], pa.string()).take(at) for k in (0, 1)]
        columns = [*pair, table["term"].combine_chunks(), table["n_sum"].combine_chunks(), table["docs_sum"].combine_chunks()]
        held.clear()
        return pa.table(columns, names=["lang", "source", "term", "n", "docs"]).to_batches(1 << 16)

    seen = 0
    for batch in batches:
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        groups = np.array([number.setdefault(x, len(number)) for x in pairs], np.int64)
        held += _by_group(groups, batch.column("text"))
        if sum(t.nbytes for t in held) > GATHERED:
            yield from handed()
        if len(number) > seen:  # a group without any term has its row as well
            new = list(number)[seen:]
            seen = len(number)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.string()), pa.nulls(len(new), pa.string()), pa.array([0] * len(new), pa.int64()), pa.array([0] * len(new), pa.int64())], ["lang", "source", "term", "n", "docs"])
    if held:
        yield from handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: a term's occurrences in a group, and the group's documents that hold it. A row with a null term stands for the group itself.

    Null texts, languages and sources count as empty ones. Texts are read whole, long ones in parts; counts are
    combined in each task before they are shuffled.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = plain.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole) for count <= whole < 9e15: long division by thousands, so that nothing overflows."""
    out = np.ones(np.broadcast_shapes(count.shape, whole.shape), np.int64)
    rest = np.broadcast_to(count, out.shape)
    digits = np.zeros_like(out)
    top, rest = np.divmod(rest, whole)
    digits += top
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + digit
    return out + digits


def _parts(df: DataFrame) -> DataFrame:
    """df in fewer and larger parts: one for JOINED shuffle partitions, but one for each core at least. Nothing is shuffled for it, and a task takes its partitions one after the other."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // JOINED))


CELL = "lang string, source string, part string, item string, value long, seen long, gap long, terms long"


def _cell(table: pa.Table) -> pa.Table:
    """The partial divergences of a cell's pairs and, on the diagonal, the terms that its groups use more than their language does."""
    i, j, lang = table["i"][0].as_py(), table["j"][0].as_py(), table["lang"][0]
    is_head = pc.is_null(table["term"])
    heads, rows = table.filter(is_head), table.filter(pc.invert(is_head))
    names = heads["source"].to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[k] for k in order]
    block = heads["block"].to_numpy()[order]
    v, whole = heads["terms"].to_numpy()[order], heads["whole"].to_numpy()[order]
    size = np.maximum(heads["n"].to_numpy()[order] + ADDED * v, 1)
    coded = rows["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    at = pc.index_in(rows["source"].combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy()
    counts = np.zeros((len(names), len(terms)), np.int64)
    counts[at, code] = rows["n"].to_numpy()
    p, rare = scaled(counts + ADDED, size[:, None]), np.where(v > 0, scaled(np.full(len(names), ADDED), np.maximum(size, ADDED)), 0)
    out = {c: [] for c in ("source", "part", "item", "value", "seen", "gap", "terms")}
    for a in range(len(names)):
        rest = np.arange(a + 1, len(names))
        rest = rest[block[rest] != block[a]] if i != j else rest
        if len(rest):
            out["value"].append(np.abs(p[rest] - p[a]).sum(axis=1))
            out["gap"].append(np.abs(rare[rest] - rare[a]))
            out["seen"].append(np.full(len(rest), len(terms)))
            out["terms"].append(np.full(len(rest), v[a]))
            out["source"] += [names[a]] * len(rest)
            out["item"] += [names[b] for b in rest]
            out["part"] += ["pair"] * len(rest)
    if i == j and len(terms):
        every = np.zeros(len(terms), np.int64)
        every[code] = rows["whole"].to_numpy()
        for a in range(len(names)):
            more = p[a] - scaled(every + ADDED, np.array(whole[a] + ADDED * v[a]))
            mine = np.flatnonzero((counts[a] > 0) & (more > 0))
            if len(mine) > LISTED:  # those with ties of the last one
                mine = mine[more[mine] >= np.partition(more[mine], -LISTED)[-LISTED]]
            out["value"].append(more[mine])
            for c in ("gap", "seen", "terms"):
                out[c].append(np.zeros(len(mine), np.int64))
            out["source"] += [names[a]] * len(mine)
            out["item"] += terms.take(pa.array(mine)).to_pylist()
            out["part"] += ["term"] * len(mine)
    longs = {c: pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64), pa.int64()) for c in ("value", "seen", "gap", "terms")}
    texts = {c: pa.array(out[c], pa.string()) for c in ("source", "part", "item")}
    lang = pa.array([lang.as_py()] * len(texts["part"]), pa.string())
    return pa.table([lang, texts["source"], texts["part"], texts["item"], *longs.values()], names=["lang", "source", "part", "item", *longs])


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: each source's distance from every other of its language, and the terms that it uses more than its language does.

    A language keeps the terms in at least LEAST_DOCS of its rows; repeated rows count each. Null texts, languages and
    sources count as empty ones, other columns are ignored; a group without terms takes part, a language without kept
    terms has distances of 0, an only source has no pairs, an empty table no rows. Ties go to the smaller item by its
    UTF-8 bytes. Counts are written to the shared folder while the plan is built; two numbers reach the driver: the
    most groups and the most kept terms of a language, from which the numbers of blocks follow.
    """
    counts = materialize(_parts(term_counts(docs)), "terms")
    known = counts.where("term is not null")
    common = known.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = materialize(_parts(known.join(common, ["lang", "term"]).select("lang", "source", "term", "n", "whole")), "kept")
    langs = kept.groupBy("lang", "term").agg(F.max("whole").alias("whole")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("whole"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    groups = (
        counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", F.lit(None).cast("string").alias("term"), *(F.coalesce(c, zero).alias(c) for c in ("n", "whole", "terms")))
    )
    groups = materialize(_parts(groups), "groups")
    most = groups.groupBy("lang").agg(F.count("*").alias("groups"), F.max("terms").alias("terms")).agg(F.max("groups"), F.max("terms")).first()
    across, deep = max(1, ceil((most[0] or 0) / GROUPS)), max(1, ceil((most[1] or 0) / TERMS))
    block = F.pmod(F.xxhash64("source"), F.lit(across)).cast("int").alias("block")
    slices = kept.select("lang", "source", "term", "n", "whole", zero.alias("terms"), block, F.pmod(F.xxhash64("term"), F.lit(deep)).cast("int").alias("k"))
    heads = groups.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("k"))
    dealt = slices.unionByName(heads).select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    partial = dealt.groupBy("lang", "i", "j", "k").applyInArrow(_cell, CELL)
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap"), F.max("terms").alias("terms"))
    summed = summed.withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.col("gap"))
    pair = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    both = F.when(F.col("part") == "pair", F.array(pair("source", "item"), pair("item", "source"))).otherwise(F.array(pair("source", "item")))
    rows = summed.select("lang", "part", "value", F.explode(both).alias("_p")).select("lang", "_p.source", "part", "_p.item", "value")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return _parts(ranked.where((F.col("part") == "pair") | (F.col("rank") <= LISTED)))


SQL = r"""
with d as materialized (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
x as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as materialized (select id, lang, source, term, count(*) as n from x group by all),
k as materialized (select lang, term, sum(n)::bigint as whole from c group by all having count(*) >= 30),
g as (select distinct lang, source from d),
v as (select lang, count(*) as v, sum(whole)::bigint as whole from k group by all),
s as materialized (select lang, source, term, sum(n)::bigint as n from c semi join k using (lang, term) group by all),
t as (select g.lang, g.source, coalesce(sum(s.n), 0)::bigint as n from g left join s on s.lang = g.lang and s.source = g.source group by all),
p as materialized (
  select t.lang, t.source, k.term, coalesce(s.n, 0) as n, 1 + 1000000000 * (coalesce(s.n, 0) + 5) // (t.n + 5 * v.v) as p, 1 + 1000000000 * (k.whole + 5) // (v.whole + 5 * v.v) as q
  from t join v using (lang) join k using (lang) left join s on s.lang = t.lang and s.source = t.source and s.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from r) where part = 'pair' or rank <= 50
"""
