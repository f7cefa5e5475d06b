"""Retrieval, filters with reasons, preference scores and the order-dependent choice of the best k."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.spread import partition_keys
from tessera.functions.text import company, family, key_tokens, menu_key, mentions, same_menu, term_key, words
from tessera.schema import UNKNOWN, Condition

#: Documents that a task holds at most, and at least if there are enough for that; queries that are compared with them at once.
CHUNK, LEAST, AT_ONCE = 65_536, 2048, 256


@dataclass(frozen=True)
class RankingConfig:
    similarity_weight: float = 0.7
    preference_weight: float = 0.3
    menu_match_weight: float = 0.3
    context_match_weight: float = 0.05
    group_key: str = "representative"
    group_cap: int = 2
    group_penalty: float = 0.0
    collapse_duplicates: bool = True


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest finite values, ties to the smaller column; what is no finite number is out."""
    sims = np.where(np.isfinite(sims), sims, -np.inf)
    if sims.shape[1] > k:
        rows, columns = np.nonzero(sims >= -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k])
    else:
        rows, columns = np.nonzero(np.ones_like(sims, dtype=bool))
    real = sims[rows, columns] > -np.inf
    rows, columns = rows[real], columns[real]
    order = np.lexsort((columns, -sims[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[nth < k], columns[nth < k]


def _whole(v: Column, dim: int) -> Column:
    """Whether a vector can be compared: right length, no null, NaN or infinite component."""
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))


def _against_chunks(queries: DataFrame, docs: DataFrame, answer, schema: str, query_id: str, doc_id: str, query_vec: str, doc_vec: str, per: str | None, limits: tuple[str, str] | None, more: tuple[Column, Column] | None = None, prepare=lambda column: column) -> DataFrame:
    """What ``answer(held, queries)`` yields for every block of queries and chunk of documents.

    Documents are dealt into chunks that a task holds as matrices, one for each value of ``per``; queries stream past each
    chunk in blocks.  Vectors that are null, hold a null or NaN, or have another length than most queries, and rows
    without an id, take no part.  ``limits`` names two columns of the queries that come along; ``more`` is a column of the
    documents, held with them as what ``prepare`` makes of it, and one of the queries (column ``a`` of their batches).
    """
    # One job for both numbers: the queries' usual length and how many documents there are.
    usual = queries.agg(F.mode(F.when(F.col(query_vec).isNotNull(), F.size(query_vec)), True).alias("d"))
    dim, total = usual.crossJoin(docs.agg(F.count("*").alias("n"))).first()
    dim = dim or 0
    kinds = dict(docs.dtypes)
    id_kind = "string" if kinds[doc_id] == "string" else "long"
    group_kind = kinds[per] if per else "int"

    def side(df: DataFrame, id_: str, vec: str) -> DataFrame:
        out = df.withColumns({"_i": F.col(id_), "_v": F.col(vec).cast("array<double>")})
        return out.filter(_whole(F.col("_v"), dim) & F.col("_i").isNotNull())

    chunks = max(1, -(-total // CHUNK), min(32, total // LEAST))
    numbers = F.array(*map(F.lit, partition_keys(chunks))).cast("array<int>")  # a chunk is a task's work, so each gets its own
    holds = more is not None
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told, asks = ((m, df.select(m.alias("m")).schema[0].dataType) for m, df in zip(more, (docs, queries))) if more else ((F.lit(0), "int"), (F.lit(0), "int"))
    here = side(docs, doc_id, doc_vec).select(
        F.element_at(numbers, F.pmod(F.xxhash64("_i"), F.lit(chunks)).cast("int") + 1).alias("chunk"), F.lit(0).alias("role"), null("long", "q"), F.col("_i").cast(id_kind).alias("i"), (F.col(per) if per else F.lit(0)).alias("g"), null("double", "s"), F.col("_v").alias("v"), told[0].alias("d"), null(asks[1], "a")
    )
    near, after = (F.col(limits[0]).cast("double"), F.col(limits[1]).cast(id_kind)) if limits else (F.lit(None).cast("double"), F.lit(None).cast(id_kind))
    sent = side(queries, query_id, query_vec).select(
        F.explode(numbers).alias("chunk"), F.lit(1).alias("role"), F.col("_i").cast("long").alias("q"), after.alias("i"), null(group_kind, "g"), near.alias("s"), F.col("_v").alias("v"), null(told[1], "d"), asks[0].alias("a")
    )

    def hold(parts: list[pa.RecordBatch]) -> list[tuple]:
        """Per group: its value, ids upwards, vectors, and what else is held."""
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, codes = _keys(table.column("i").combine_chunks()), table.column("g").combine_chunks().dictionary_encode(null_encoding="encode")
        x, number = _matrix(table.column("v").combine_chunks(), dim), codes.indices.to_numpy()
        order = np.lexsort((ids, number))
        cuts = np.r_[0, np.flatnonzero(np.diff(number[order])) + 1, len(order)]
        told_ = table.column("d").combine_chunks()
        return [(codes.dictionary[int(number[order[s]])], ids[order[s:e]], x[order[s:e]], prepare(told_.take(pa.array(order[s:e]))) if holds else None) for s, e in zip(cuts[:-1], cuts[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                of, role = (batch.column(n).to_numpy() for n in range(2))
                cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (role[1:] != role[:-1])) + 1, len(of)]
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if of[s] != at:
                        at, parts, held = of[s], [], None
                    piece = batch.slice(s, e - s)
                    if role[s] == 0:
                        parts.append(piece)
                    elif parts:
                        held = held or hold(parts)
                        q = piece.column("q").to_numpy()
                        yield from answer(held, q, _matrix(piece.column("v"), dim), piece)

    return here.unionByName(sent).repartition(chunks, "chunk").sortWithinPartitions("chunk", "role").mapInArrow(run, schema)


def _keys(ids: pa.Array) -> np.ndarray:
    """Ids that numpy can order: numbers, or texts by code point."""
    out = ids.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy().reshape(len(v), dim)


def top_k_similar(
    queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, query_vec: str = "embedding", doc_vec: str = "embedding", exclude_self: bool = False, digits: int = 6, per: str | None = None
) -> DataFrame:
    """``query_id, <doc_id>, sim, rank``: the k documents with the largest dot product of each query, ties to the smaller id;
    with ``per`` the k best of each value of that column of ``docs``, and the value.

    ``sim`` is rounded before it is ranked.  Every query meets every document, in blocks; only a chunk's k best travel, and
    nothing is brought to the driver.  Unusable vectors take no part; empty tables give no rows.
    """
    kinds = dict(docs.dtypes)
    id_kind, group_kind = ("string" if kinds[doc_id] == "string" else "long"), (kinds[per] if per else "int")

    def answer(held: list[tuple], q: np.ndarray, x: np.ndarray, _: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for value, ids, own, _ in held:
            sims = np.round(x @ own.T, digits)
            if exclude_self:
                sims[q[:, None] == ids[None, :]] = -np.inf
            rows, columns = _best(sims, k)
            if len(rows):
                made = [pa.array(q[rows]), pa.array(ids[columns]), pa.array([value.as_py()] * len(rows), value.type), pa.array(sims[rows, columns])]
                yield pa.RecordBatch.from_arrays(made, ["q", "i", "g", "sim"])

    found = _against_chunks(queries, docs, answer, f"q long, i {id_kind}, g {group_kind}, sim double", query_id, doc_id, query_vec, doc_vec, per, None)
    best = Window.partitionBy(*(["q", "g"] if per else ["q"])).orderBy(F.desc("sim"), "i")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("i").alias(doc_id), "sim", "rank", *([F.col("g").alias(per)] if per else []))


def places(limits: DataFrame, docs: DataFrame, query_id: str, doc_id: str, sim: str, at: str, query_vec: str = "embedding", doc_vec: str = "embedding", exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """``query_id, rank``: the rank of the document ``at``, of similarity ``sim``, among all documents of its query.

    Each chunk counts the documents ahead of it, so that only one number per query and chunk travels.
    """

    def answer(held: list[tuple], q: np.ndarray, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near, after = batch.column("s").to_numpy()[:, None], _keys(batch.column("i"))[:, None]
        for _, ids, own, _ in held:
            sims = np.round(x @ own.T, digits)
            if exclude_self:
                sims[q[:, None] == ids[None, :]] = -np.inf
            ahead = (sims > near) | (sims == near) & (ids[None, :] < after)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ahead.sum(axis=1))], ["q", "n"])

    found = _against_chunks(limits, docs, answer, "q long, n long", query_id, doc_id, query_vec, doc_vec, None, (sim, at))
    return found.groupBy(F.col("q").alias("query_id")).agg((F.sum("n") + 1).alias("rank"))


class Bitmaps:
    """Which of a chunk's documents have each of their facts, and which pass a query's conditions.

    A condition is a list of facts of which a document must have one; then come the facts that it must not have.  What a
    combination of conditions lets through is worked out once for all queries that share it.
    """

    def __init__(self, facts: pa.Array, remembered: int = 256):
        codes = facts.flatten().dictionary_encode()
        number = codes.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(facts)), facts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(len(codes.dictionary) + 1))
        self.n, self.remembered = len(facts), remembered
        self.rows = {f: owner[order[a:b]] for f, a, b in zip(codes.dictionary.to_pylist(), cuts[:-1], cuts[1:])}
        self.known: dict[tuple, tuple[np.ndarray, list[dict]]] = {}

    def having(self, facts: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(self.n, bool)
        for f in facts:
            out[self.rows.get(f, [])] = True
        return out

    def passing(self, must: tuple[tuple[str, ...], ...], out: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[dict]]:
        """The documents that pass, and how many fail for each reason: every condition failed, with the value that the document
        has instead, or else the first of ``out``."""
        if (must, out) not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            good, why = np.ones(self.n, bool), {}
            for facts in must:
                met = self.having(facts)
                head = facts[0].rpartition(FACT)[0] + FACT
                left = ~met
                for fact, rows in self.rows.items():
                    if fact.startswith(head) and (n := int((~met[rows]).sum())):
                        reason = fact.removeprefix(LABEL).replace(FACT, "=")
                        why[reason] = why.get(reason, 0) + n
                        left[rows] = False
                if left.any():
                    reason = f"{head.removeprefix(LABEL).removesuffix(FACT)}={UNKNOWN}"
                    why[reason] = why.get(reason, 0) + int(left.sum())
                good &= met
            for fact, term in out:
                hit = good & self.having((fact,))
                if hit.any():
                    reason = f"메뉴={term}"
                    why[reason] = why.get(reason, 0) + int(hit.sum())
                good &= ~hit
            self.known[must, out] = good, [{"reason": r, "n": n} for r, n in why.items()]
        return self.known[must, out]


#: Marks of facts: a label's attribute and value, and a word or whole field that a menu term may equal.
FACT, LABEL, WORD = "\x1f", "l\x1f", "w\x1f"


def facts_of(labels: Column, name: Column, representative: Column, category: Column) -> Column:
    """A record's facts: its labels but empty ones, and what :func:`mentions` compares a term with."""
    known = F.filter(F.map_entries(labels), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    said = F.array_compact(F.concat(words(name), F.array(representative, category), words(category)))
    return F.concat(F.coalesce(F.transform(known, lambda e: F.concat(F.lit(LABEL), e["key"], F.lit(FACT), e["value"])), F.array().cast("array<string>")), F.transform(F.array_distinct(said), lambda w: F.concat(F.lit(WORD), w)))


def asked_facts(hard: Column, excluded: Column) -> Column:
    """A query's conditions as facts; ``excluded`` are menu terms."""
    must = F.transform(hard, lambda c: F.transform(c["allowed"], lambda v: F.concat(F.lit(LABEL), c["attribute"], F.lit(FACT), v)))
    out = F.transform(excluded, lambda t: F.named_struct(F.lit("fact"), F.concat(F.lit(WORD), term_key(t)), F.lit("said"), t))
    return F.named_struct(F.lit("must"), must, F.lit("out"), out)


def filtered_search(queries: DataFrame, docs: DataFrame, near: int, kept: int, facts: Column, asked: Column, query_id: str, doc_id: str, query_vec: str, doc_vec: str = "embedding", digits: int = 9) -> DataFrame:
    """One pass over all documents for all queries: rows ``query_id, <doc_id>, sim, passes`` of the ``near`` most similar and of
    the ``kept`` most similar that pass, and one row per query and chunk with ``n_pass`` and ``reasons`` over all documents.

    Documents are held with bitmaps of their facts, so conditions are tested inside the search and what fails beyond the
    nearest never travels.
    """
    id_kind = "string" if dict(docs.dtypes)[doc_id] == "string" else "long"

    def answer(held: list[tuple], q: np.ndarray, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wants = [(tuple(map(tuple, a["must"])), tuple((o["fact"], o["said"]) for o in a["out"])) for a in batch.column("a").to_pylist()]
        for _, ids, own, maps in held:
            good = [maps.passing(*w) for w in wants]
            sims = np.round(x @ own.T, digits)
            able = np.array([g[0] for g in good])
            first = _best(sims, near)
            rows, columns = (np.concatenate(both) for both in zip(first, _best(np.where(able, sims, -np.inf), kept)))
            _, once = np.unique(rows * len(ids) + columns, return_index=True)
            rows, columns = rows[once], columns[once]
            n, m = len(rows), len(q)
            out = [pa.array(np.r_[q[rows], q]), pa.concat_arrays([pa.array(ids[columns], pa.string() if id_kind == "string" else pa.int64()), pa.nulls(m, pa.string() if id_kind == "string" else pa.int64())])]
            out += [pa.array([*sims[rows, columns], *[None] * m], pa.float64()), pa.array([*able[rows, columns], *[None] * m], pa.bool_())]
            out += [pa.array([None] * n + [int(g[0].sum()) for g in good], pa.int64()), pa.array([None] * n + [g[1] for g in good], pa.list_(pa.struct([("reason", pa.string()), ("n", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(out, ["q", "i", "sim", "passes", "n_pass", "reasons"])

    schema = f"q long, i {id_kind}, sim double, passes boolean, n_pass long, reasons array<struct<reason:string,n:long>>"
    found = _against_chunks(queries, docs, answer, schema, query_id, doc_id, query_vec, doc_vec, None, None, (facts, asked), Bitmaps)
    return found.withColumnsRenamed({"q": "query_id", "i": doc_id})


def places_of(lists: DataFrame, docs: DataFrame, query_id: str, doc_id: str, query_vec: str, doc_vec: str = "embedding", digits: int = 9) -> DataFrame:
    """``query_id, nth, rank``: the rank among all documents of the nth entry (from 1) of each query's ``list`` (array of struct
    (sim, id)).  Each chunk counts the documents ahead of every entry, so only numbers travel."""

    def answer(held: list[tuple], q: np.ndarray, x: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = batch.column("a").to_pylist()
        for _, ids, own, _ in held:
            sims = np.round(x @ own.T, digits)
            out: list[list] = [[], [], []]
            for i, entries in enumerate(asked):
                order = np.argsort(-sims[i], kind="stable")  # ids stand upwards already
                down, after = -sims[i][order], ids[order]
                for nth, e in enumerate(entries, 1):
                    low, high = np.searchsorted(down, -e["sim"], "left"), np.searchsorted(down, -e["sim"], "right")
                    out[0].append(q[i])
                    out[1].append(nth)
                    out[2].append(int(low + np.searchsorted(after[low:high], e["id"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["q", "nth", "n"])

    found = _against_chunks(lists, docs, answer, "q long, nth long, n long", query_id, doc_id, query_vec, doc_vec, None, None, (F.lit(0), F.col("list")))
    return found.groupBy(F.col("q").alias("query_id"), "nth").agg((F.sum("n") + 1).alias("rank"))


def label(labels: Column, attribute: str) -> Column:
    """A record's label; missing and empty ones are unknown."""
    return F.coalesce(F.nullif(labels[attribute], F.lit("")), F.lit(UNKNOWN))


def drop_reasons(labels: Column, hard: list[Condition]) -> Column:
    """Structs (attribute, value, allowed, evidence, unknown) of the hard conditions that a record fails; unknown always fails."""
    out = []
    for c in hard:
        value = label(labels, c.attribute)
        reason = F.struct(
            F.lit(c.attribute).alias("attribute"),
            value.alias("value"),
            F.array(*map(F.lit, c.allowed)).cast("array<string>").alias("allowed"),
            F.lit(c.evidence).alias("evidence"),
            (value == UNKNOWN).alias("unknown"),
        )
        out.append(F.when(~value.isin(*c.allowed), reason))
    kind = "array<struct<attribute:string,value:string,allowed:array<string>,evidence:string,unknown:boolean>>"
    return F.array_compact(F.array(*out)) if out else F.array().cast(kind)


def failed_conditions(labels: Column, hard: Column) -> Column:
    """:func:`drop_reasons` for conditions that a column holds (an array of conditions in each row)."""
    failed = F.filter(hard, lambda c: ~F.array_contains(c["allowed"], label(labels, c["attribute"])))

    def reason(c: Column) -> Column:
        value = label(labels, c["attribute"])
        return F.struct(c["attribute"].alias("attribute"), value.alias("value"), c["allowed"].alias("allowed"), c["evidence"].alias("evidence"), (value == UNKNOWN).alias("unknown"))

    return F.transform(failed, reason)


def met_preferences(labels: Column, soft: Column) -> Column:
    """:func:`preference` for conditions that a column holds."""

    def part(keep) -> Column:
        chosen = F.filter(soft, lambda c: keep(F.array_contains(c["allowed"], label(labels, c["attribute"])), label(labels, c["attribute"]) == UNKNOWN))
        return F.transform(chosen, lambda c: F.struct(c["attribute"].alias("attribute"), label(labels, c["attribute"]).alias("value"), c["evidence"].alias("evidence")))

    matched = part(lambda met, _: met)
    share = F.when(F.size(soft) > 0, F.size(matched) / F.size(soft).cast("double")).otherwise(F.lit(0.0))
    return F.struct(share.alias("score"), matched.alias("matched"), part(lambda met, unknown: ~met & ~unknown).alias("unmatched"), part(lambda met, unknown: ~met & unknown).alias("unknown"))


def first_of(terms: Column, name: Column, representative: Column, category: Column) -> Column:
    """:func:`first_mention` for terms that a column holds."""
    return F.try_element_at(F.filter(terms, lambda t: mentions(t, name, representative, category)), F.lit(1))


def first_mention(terms: list[str], name: Column, representative: Column, category: Column) -> Column:
    """The first of ``terms`` that points at the record, or null."""
    hits = [F.when(mentions(t, name, representative, category), F.lit(t)) for t in terms]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def preference(labels: Column, soft: list[Condition]) -> Column:
    """Struct (score, matched, unmatched, unknown): the share of soft conditions met, and which; 0 without conditions."""
    entries = {"matched": [], "unmatched": [], "unknown": []}
    for c in soft:
        value = label(labels, c.attribute)
        entry = F.struct(F.lit(c.attribute).alias("attribute"), value.alias("value"), F.lit(c.evidence).alias("evidence"))
        met = value.isin(*c.allowed)
        for name, when in (("matched", met), ("unmatched", ~met & (value != UNKNOWN)), ("unknown", ~met & (value == UNKNOWN))):
            entries[name].append(F.when(when, entry))
    kind = "array<struct<attribute:string,value:string,evidence:string>>"
    lists = {n: F.array_compact(F.array(*e)) if e else F.array().cast(kind) for n, e in entries.items()}
    score = F.size(lists["matched"]) / F.lit(float(len(soft))) if soft else F.lit(0.0)
    return F.struct(score.cast("double").alias("score"), *(c.alias(n) for n, c in lists.items()))


def final_score(sim: Column, pref: Column, menu: Column, context: Column, config: RankingConfig) -> Column:
    """Weighted similarity and preference, and the larger of the two match bonuses."""
    bonus = F.greatest(F.when(menu, config.menu_match_weight).otherwise(0.0), F.when(context, config.context_match_weight).otherwise(0.0))
    return config.similarity_weight * sim + config.preference_weight * pref + bonus


def score_candidates(candidates: DataFrame, config: RankingConfig) -> DataFrame:
    """``candidates`` (record, sim, and the arrays soft, menu_terms and context of their query) with pref, menu_hit and score."""
    record = (F.col("name"), F.col("representative"), F.col("category"))
    none = F.lit(None).cast("string")
    menu = first_of(F.col("menu_terms"), *record) if config.menu_match_weight else none
    context = first_of(F.col("context"), *record) if config.context_match_weight else none
    out = candidates.withColumns({"pref": met_preferences(F.col("labels"), F.col("soft")), "_menu": menu, "_context": context})
    score = final_score(F.col("sim"), F.col("pref.score"), F.col("_menu").isNotNull(), F.col("_context").isNotNull(), config)
    return out.withColumns({"score": score, "menu_hit": F.coalesce("_menu", "_context")}).drop("_menu", "_context")


def best_first(score: str = "score", sim: str = "sim", id_: str = "id") -> list[Column]:
    """The final order: score and similarity downwards (nine digits), then the id."""
    return [F.desc(F.round(score, 9)), F.desc(F.round(sim, 9)), F.asc(id_)]


def choice_columns(config: RankingConfig) -> dict[str, Column]:
    """The columns that :func:`select_top_k` compares records by; without the collapse of variants names need no key."""
    if not config.collapse_duplicates:
        blank = F.lit("")
        none = F.struct(blank.alias("key"), blank.alias("company"), F.array().cast("array<string>").alias("parts"))
        return {"_key": none, "_group": family(F.col(config.group_key), F.col("company"))}
    return {
        "_key": F.struct(menu_key(F.col("name")).alias("key"), company(F.col("company")).alias("company"), key_tokens(F.col("name")).alias("parts")),
        "_group": family(F.col(config.group_key), F.col("company")),
    }


def select_top_k(scored: DataFrame, k: int, config: RankingConfig, by: list[str], exempt: Column | None = None, id_: str = "id", free: Column | None = None, carry: Column | None = None) -> DataFrame:
    """Per ``by`` one row with ``selected`` and ``skipped``: arrays of structs (id, name, score, group, pos, reason, row).

    ``exempt``, an array of groups, or ``free``, a condition, frees rows from the cap; ``row`` is what ``carry`` holds.

    Records are taken best first; a variant of one taken before and one whose group is at the cap are skipped, until k
    are taken.  With a group penalty the best is sought anew at each step, from a sorted stream (:class:`Penalised`).  The rule
    depends on the order and duplicates are not transitive, so without a penalty each list is folded in order, inside the
    JVM; a list holds what its query retrieved, so callers bound it by the query's range.
    """
    table = scored.withColumns(choice_columns(config))
    table = table.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first(id_=id_))))
    if free is None:
        free = F.lit(False) if exempt is None else F.array_contains(exempt, F.col("_group"))
    item = F.struct(
        F.col("_pos").alias("pos"), F.col(id_).alias("id"), F.col("name"), F.col("score"), F.col("_group").alias("group"), F.col("_key").alias("key"),
        F.coalesce(free, F.lit(False)).alias("free"), F.lit("").alias("reason"), (F.lit(None).cast("string") if carry is None else carry).alias("row"),
    )
    if config.group_penalty:
        return _penalised(table.select(*by, item.alias("item")), k, config, by)
    lists = table.groupBy(*by).agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("items"))
    none = F.filter("items", lambda _: F.lit(False))

    def with_reason(x: Column, reason: Column) -> Column:
        return x.withField("reason", reason)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        """What the two lists become after x."""
        twin = F.try_element_at(F.filter(state["selected"], lambda s: same_menu(s["key"], x["key"])), F.lit(1)) if config.collapse_duplicates else F.lit(None)
        full = (F.size(F.filter(state["selected"], lambda s: s["group"] == x["group"])) >= config.group_cap) & ~x["free"] if config.group_cap else F.lit(False)
        double = twin.isNotNull() if config.collapse_duplicates else F.lit(False)
        why = F.concat(F.lit("duplicate: "), twin["name"]) if config.collapse_duplicates else F.lit("")
        cap = F.concat(F.lit(f"{config.group_key} cap({config.group_cap}): "), x["group"])
        reason = F.when(double, why).otherwise(F.when(full, cap).otherwise(F.lit("")))
        taken = ~double & ~full
        selected = F.when(taken, F.concat(state["selected"], F.array(x))).otherwise(state["selected"])
        skipped = F.when(taken, state["skipped"]).otherwise(F.concat(state["skipped"], F.array(with_reason(x, F.coalesce(reason, F.lit(""))))))
        return selected, skipped

    start = F.struct(none.alias("selected"), none.alias("skipped"))

    def fold(state: Column, x: Column) -> Column:
        selected, skipped = step(state, x)
        more = F.struct(selected.alias("selected"), skipped.alias("skipped"))
        return F.when(F.size(state["selected"]) < k, more).otherwise(state)

    out = F.aggregate("items", start, fold)
    return lists.select(*by, out.alias("_out")).select(*by, "_out.selected", "_out.skipped")


def is_variant(a: dict, b: dict) -> bool:
    """:func:`same_menu` for two keys outside the JVM."""
    if not a["key"] or not b["key"]:
        return False
    if a["key"] == b["key"] or a["company"] != b["company"]:
        return a["key"] == b["key"]
    if a["company"]:
        return a["key"].startswith(b["key"]) or b["key"].startswith(a["key"])
    short = min(len(a["parts"]), len(b["parts"]))
    return a["parts"][:short] == b["parts"][:short]


class Penalised:
    """The choice of one query with a group penalty, fed with its records best first.

    Every group waits with its best record in a heap, worth its score less the penalty for those of the group taken before;
    worths in the heap may be too high and are put right when they come up.  A record is taken once nothing that is still
    to come can be worth more, so no more is read than the choice needs, and only what was read is held.
    """

    #: Scores are ordered by nine digits: one still to come is at most this much above the last.
    SLACK = 1e-9

    def __init__(self, k: int, config: RankingConfig):
        self.k, self.config = k, config
        self.selected: list[dict] = []
        self.skipped: list[dict] = []
        self.held: dict[str | None, int] = {}
        self.waiting: dict[tuple, list[tuple]] = {}
        self.heads: list[tuple] = []

    def _key(self, x: dict) -> tuple:
        return ("free",) if x["free"] else ("group", x["group"])

    def _worth(self, x: dict) -> float:
        return x["score"] - (0.0 if x["free"] else self.config.group_penalty * self.held.get(x["group"], 0))

    def _show(self, key: tuple) -> None:
        if own := self.waiting.get(key):
            x = own[0][2]
            heapq.heappush(self.heads, (-self._worth(x), x["pos"], key))

    def feed(self, x: dict) -> bool:
        """Take in the next record; whether more are needed."""
        key = self._key(x)
        own = self.waiting.setdefault(key, [])
        heapq.heappush(own, (-x["score"], x["pos"], x))
        if own[0][2] is x:
            self._show(key)
        self.settle(x["score"] + self.SLACK)
        return len(self.selected) < self.k

    def settle(self, to_come: float = -math.inf) -> None:
        """Take what is worth at least as much as anything to come."""
        while self.heads and len(self.selected) < self.k:
            worth, pos, key = self.heads[0]
            own = self.waiting.get(key)
            if not own or own[0][1] != pos:
                heapq.heappop(self.heads)  # a better one of the group was shown later, or this one is gone
                continue
            x = own[0][2]
            if -worth > self._worth(x):
                heapq.heapreplace(self.heads, (-self._worth(x), pos, key))
                continue
            if -worth < to_come:
                return
            heapq.heappop(self.heads)
            heapq.heappop(own)
            self._decide(x)
            self._show(key)

    def _decide(self, x: dict) -> None:
        c = self.config
        twin = next((s for s in self.selected if is_variant(s["key"], x["key"])), None) if c.collapse_duplicates else None
        if twin is not None:
            self.skipped.append(x | {"reason": f"duplicate: {twin['name']}"})
        elif c.group_cap and not x["free"] and self.held.get(x["group"], 0) >= c.group_cap:
            self.skipped.append(x | {"reason": f"{c.group_key} cap({c.group_cap}): {x['group']}"})
        else:
            self.selected.append(x)
            self.held[x["group"]] = self.held.get(x["group"], 0) + 1


def _penalised(table: DataFrame, k: int, config: RankingConfig, by: list[str]) -> DataFrame:
    """``by, selected, skipped`` from rows (by, item): a query's rows stream past its :class:`Penalised` in order, never as a list."""
    kinds = T.ArrayType(table.schema["item"].dataType)
    schema = table.select(*by).schema.add("selected", kinds).add("skipped", kinds)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, choice, more, columns = None, None, False, None

        def done() -> pa.RecordBatch:
            choice.settle()
            made = [pa.array([v], c.type) for v, c in zip(at, columns)]
            made += [pa.array([rows], pa.list_(columns[n].type)) for rows in (choice.selected, choice.skipped)]
            return pa.RecordBatch.from_arrays(made, schema.names)

        for batch in batches:
            columns = batch.columns
            keys = list(zip(*(c.to_pylist() for c in columns[:n])))
            for i, key in enumerate(keys):
                if key != at:
                    if choice is not None:
                        yield done()
                    at, choice, more = key, Penalised(k, config), True
                if more:
                    more = choice.feed(columns[n][i].as_py())
        if choice is not None:
            yield done()

    return table.repartition(*by).sortWithinPartitions(*by, "item.pos").mapInArrow(run, schema)


def cap_per_group(ranked: DataFrame, cap: int, k: int, by: str, group: str, order: list[Column]) -> DataFrame:
    """At most ``cap`` rows per group and k per ``by``, in order; the choice above without duplicates, as two windows."""
    table = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(by, group).orderBy(*order))).filter(F.col("_n") <= cap)
    return table.withColumn("pick", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("pick") <= k).drop("_n")


def pick_per_keyword(items: DataFrame, limit: int, keyword: str, score: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The best row of each keyword, then the ``limit`` best of these; ``score`` is rounded to 4 digits in the result."""
    by = by or []
    table = items.withColumn("_score", score)
    best = [F.desc("_score"), *order]
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy(*by, keyword).orderBy(*best))).filter("_n = 1").drop("_n")
    if by:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("_n") <= limit).drop("_n")
    else:
        first = first.orderBy(*best).limit(limit)
    return first.withColumn("score", F.round("_score", 4)).drop("_score")


def reason_histogram(dropped: DataFrame, reasons: str = "reasons") -> DataFrame:
    """``reason`` ("attribute=value") and how many dropped records have it."""
    r = dropped.select(F.explode(reasons).alias("r"))
    return r.groupBy(F.concat_ws("=", "r.attribute", "r.value").alias("reason")).agg(F.count("*").alias("n"))
