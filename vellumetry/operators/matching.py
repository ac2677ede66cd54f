"""Matching the rows of two versions of a document, and documents by name.

Order decides matches here: leftover codes choose one after another (by length and value),
rows without a code are matched greedily over all candidates. So leftovers are assigned pair by pair in
Python; joins on codes and all numbers are Catalyst's. For candidate sets of any size, mutual_best gives
the greedy matching by joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.similarity import label_similarity, share, shares_similarity, token_jaccard
from ..functions.text import characters, meaningful, normalize, tokens
from ..functions.unicode import nfkc_casefold, sequence_ratio, without_marks
from ..plans.lineage import cut

#: Least label similarity across codes and for labels alone; of meaningful words, least Jaccard similarity and count shared; of file names, least score and least Jaccard similarity.
CROSS_CODE, LABEL_ONLY, SHARED_RATIO, SHARED_WORDS, FILE_SCORE, FILE_WORDS = 0.80, 0.60, 0.50, 2, 0.82, 0.55


def with_sets(df: DataFrame, text: str, sections: str = "cyrillic", unicode: bool = True) -> DataFrame:
    """df with norm, words, chars of a text column, made once a row rather than once a pair."""
    out = df.withColumn("norm", normalize(F.coalesce(F.col(text), F.lit("")), sections, unicode))
    return out.withColumn("words", tokens(F.col("norm"))).withColumn("chars", characters(F.col("norm")))


def label_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float = LABEL_ONLY) -> DataFrame:
    """left_id, right_id, sim, tj, shared of the pairs that could match: sim >= least, or enough meaningful words shared.

    Both sides come from with_sets. For least > 0.5 a pair without a common word cannot match, but for pairs
    without meaningful words on both sides, so pairs come from a join on words, not from all with all.
    """
    if least <= 0.5:
        raise ValueError("characters alone can reach 0.5: such pairs need no common word")

    # sizes are made and written before words are exploded: beside explode they would be made for every word
    def sized(d: DataFrame, key: str) -> DataFrame:
        return cut(d.select(key, "words", "chars", F.size("words").alias("n"), F.size(meaningful(F.col("words"))).alias("m")))

    def words(d: DataFrame, key: str, side: str) -> DataFrame:
        return d.select(key, F.col("n").alias(f"{side}_n"), F.col("m").alias(f"{side}_m"), F.explode("words").alias("word"))

    left, right = sized(left, left_id), sized(right, right_id)
    a, b = words(left, left_id, "a"), words(right, right_id, "b")
    both = a.join(b, "word").groupBy(left_id, right_id, "a_n", "b_n", "a_m", "b_m").agg(F.count("*").alias("all"), F.count_if(F.length("word") >= 3).alias("shared"))
    n_words = lambda d, key, side: d.filter("m = 0").select(key, F.col("words").alias(f"{side}_words"))
    bare = n_words(left, left_id, "a").join(n_words(right, right_id, "b"), F.lit(True)).withColumns({"tj": F.lit(1.0), "shared": F.lit(0).cast("long"), "ratio": share(F.col("a_words"), F.col("b_words"))})
    tj = F.when(F.col("a_m") + F.col("b_m") > 0, F.col("shared") / (F.col("a_m") + F.col("b_m") - F.col("shared"))).otherwise(1.0)
    ratio = F.col("all") / (F.col("a_n") + F.col("b_n") - F.col("all"))
    agree = (F.col("tj") >= SHARED_RATIO) | (F.col("shared") >= SHARED_WORDS)
    likely = both.withColumns({"tj": tj, "ratio": ratio}).filter((F.col("a_m") + F.col("b_m") > 0) & ((0.5 * F.col("ratio") + 0.5 >= least - 1e-4) | agree))
    pairs = likely.select(left_id, right_id, "tj", "shared", "ratio").unionByName(bare.drop("a_words", "b_words"))
    # of words, the share is known from the counts; only characters are fetched
    chars = lambda d, key, side: d.select(key, F.col("chars").alias(f"{side}_chars"))
    pairs = pairs.join(chars(left, left_id, "a"), left_id).join(chars(right, right_id, "b"), right_id)
    pairs = pairs.withColumn("sim", shares_similarity(F.col("ratio"), F.col("a_chars"), F.col("b_chars")))
    return pairs.filter((F.col("sim") >= least) | agree).select(left_id, right_id, "sim", "tj", "shared")


def mutual_best(edges: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The greedy one-to-one matching by score (falling), then left, then right.

    An edge that is the best of both its ends is in it; such edges are taken, their ends go, and so on. Each
    round at least the best edge of all is taken.
    """
    left_kind, right_kind = edges.schema[left].dataType, edges.schema[right].dataType
    rest = cut(edges.select(left, right, score))
    taken = []
    key = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    while not rest.isEmpty():
        best_l = rest.groupBy(left).agg(F.min(key).alias("best")).select(F.col("best.l").alias(left), F.col("best.r").alias(right))
        best_r = rest.groupBy(right).agg(F.min(key).alias("best")).select(F.col("best.l").alias(left), F.col("best.r").alias(right))
        got = cut(rest.join(best_l, [left, right], "left_semi").join(best_r, [left, right], "left_semi"))
        taken.append(got)
        rest = cut(rest.join(got.select(left), left, "left_anti").join(got.select(right), right, "left_anti"))
    out = taken[0] if taken else edges.sparkSession.createDataFrame([], edges.select(left, right, score).schema)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(F.col(left).cast(left_kind), F.col(right).cast(right_kind), score)


LINKS = "pair_id string, stage int, gt_ref string, res_ref string, sim double"


def _similar(a: dict, b: dict) -> float:
    """As label_similarity, of rows with their sets."""
    if not a["chars"] or not b["chars"]:
        return float(not a["chars"] and not b["chars"])
    share = lambda x, y: len(x & y) / (len(x | y) or 1)
    return round(0.5 * share(a["words"], b["words"]) + 0.5 * share(a["chars"], b["chars"]), 4)


def _agree(a: dict, b: dict) -> bool:
    """Whether enough meaningful words are shared."""
    x, y = ({w for w in r["words"] if len(w) >= 3} for r in (a, b))
    both = len(x & y)
    return both >= SHARED_WORDS or (not x and not y) or both >= SHARED_RATIO * (len(x | y) or 1)


class _Free:
    """Rows in order, found by their words. Rows that can match without a common word, as neither has a meaningful one, are kept apart."""

    def __init__(self, rows: list[dict]):
        self.rows, self.by_word, self.bare = rows, {}, []
        for k, r in enumerate(rows):
            for w in r["words"]:
                self.by_word.setdefault(w, []).append(k)
            if not any(len(w) >= 3 for w in r["words"]):
                self.bare.append(k)

    def like(self, a: dict) -> set[int]:
        """Places of all rows that a may match."""
        found = {k for w in a["words"] for k in self.by_word.get(w, ())}
        return found if any(len(w) >= 3 for w in a["words"]) else found.union(self.bare)


def _choose(choosers: list[dict], free: list[dict], allowed) -> list[tuple[dict, dict, float]]:
    """One after another, each takes the most similar free row that it may have, the first of equals."""
    out, index, gone = [], _Free(free), set()
    for a in choosers:
        fits = [(s, -k) for k in index.like(a) - gone if allowed(a, free[k], s := _similar(a, free[k]))]
        if fits:
            s, k = max(fits)
            gone.add(-k)
            out.append((a, free[-k], s))
    return out


def _greedy(left: list[dict], right: list[dict]) -> list[tuple[dict, dict, float]]:
    index = _Free(right)
    edges = sorted((-s, i, j) for i, a in enumerate(left) for j in index.like(a) if (s := _similar(a, right[j])) >= LABEL_ONLY or _agree(a, right[j]))
    used_l, used_r, out = set(), set(), []
    for s, i, j in edges:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.append((left[i], right[j], -s))
    return out


def _links(rows: list[dict], exclusive: bool) -> list[tuple]:
    """(pair_id, stage, gt_ref, res_ref, sim): the leftovers of one pair of documents, assigned."""
    side = {}
    for r in rows:
        r |= {"words": set(r["words"]), "chars": set(r["chars"])}
        side.setdefault((r["side"], r["code"] is not None), []).append(r)
    coded = {s: sorted(side.get((s, True), []), key=lambda r: (len(r["code"]), r["code"])) for s in ("gt", "res")}
    bare = {s: sorted(side.get((s, False), []), key=lambda r: r["ordinal"]) for s in ("gt", "res")}
    links = [(2, a, b, s) for a, b, s in _choose(coded["gt"], coded["res"], lambda a, b, s: s >= CROSS_CODE)]
    gone = {id(r) for _, a, b, _ in links for r in (a, b)}
    mixed = lambda a, b, s: s >= CROSS_CODE or _agree(a, b)
    links += [(3, a, b, s) for a, b, s in _choose([r for r in coded["gt"] if id(r) not in gone], bare["res"], mixed)]
    links += [(4, b, a, s) for a, b, s in _choose([r for r in coded["res"] if id(r) not in gone], bare["gt"], mixed)]
    if exclusive:
        gone |= {id(r) for _, a, b, _ in links for r in (a, b)}
    links += [(5, a, b, s) for a, b, s in _greedy(*([r for r in bare[s] if id(r) not in gone] for s in ("gt", "res")))]
    return [(rows[0]["pair_id"], k, a["ref"], b["ref"], s) for k, a, b, s in links]


def _assign(exclusive: bool):
    """Many pairs a call: rows come sorted by pair, and one pair's are held at a time."""

    def run(batches):
        def batch(found):
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["pair_id", "stage", "gt_ref", "res_ref", "sim"])

        rows = []
        for b in batches:
            found = []
            for r in b.to_pylist():
                if rows and r["pair_id"] != rows[0]["pair_id"]:
                    found += _links(rows, exclusive)
                    rows = []
                rows.append(r)
            yield batch(found)
        if rows:
            yield batch(_links(rows, exclusive))

    return run


def compared(coded: DataFrame, bare: DataFrame, sections: str = "cyrillic", unicode: bool = True, exclusive_bare: bool = False) -> DataFrame:
    """Rows of both sides beside each other: pair_id, stage, labels, numbers, similarities, differences.

    coded and bare: pair_id, side ('gt' or 'res'), ordinal, (code,) label, start, end. Stages: 1 same code, 2 other
    code, 3 and 4 code with none, 5 no codes; 6 is one-sided. Rows without a code that stages 3 and 4
    took still take part in stage 5, unless exclusive_bare.
    """
    cols = ["pair_id", "side", "code", "ordinal", "label", "start", "end"]
    every = coded.select(*cols).unionByName(bare.withColumn("code", F.lit(None).cast("string")).select(*cols))
    every = every.withColumn("ref", F.coalesce(F.concat(F.lit("c"), "code"), F.concat(F.lit("n"), F.col("ordinal").cast("string"))))
    every = cut(with_sets(every, "label", sections, unicode))
    side = {s: every.filter(F.col("side") == s) for s in ("gt", "res")}
    same = side["gt"].filter("code is not null").alias("g").join(side["res"].filter("code is not null").alias("r"), ["pair_id", "code"])
    first = same.select("pair_id", F.lit(1).alias("stage"), F.col("g.ref").alias("gt_ref"), F.col("r.ref").alias("res_ref"), label_similarity(F.col("g.words"), F.col("g.chars"), F.col("r.words"), F.col("r.chars")).alias("sim"))
    left = every.join(first.select("pair_id", F.col("gt_ref").alias("ref")), ["pair_id", "ref"], "left_anti")
    left = left.select("pair_id", "side", "code", "ordinal", "ref", "words", "chars").withColumn("sides", F.size(F.collect_set("side").over(Window.partitionBy("pair_id")))).filter("sides = 2")
    more = left.drop("sides").sortWithinPartitions("pair_id").mapInArrow(_assign(exclusive_bare), LINKS)
    links = cut(first.unionByName(more))
    row = lambda s, p: side[s].select("pair_id", F.col("ref").alias(f"{s}_ref"), *[F.col(c).alias(f"{p}_{c}") for c in ("code", "label", "start", "end")])
    paired = links.join(row("gt", "g"), ["pair_id", "gt_ref"]).join(row("res", "r"), ["pair_id", "res_ref"])
    alone = []
    for s, p, q in (("gt", "g", "r"), ("res", "r", "g")):
        rest = row(s, p).join(links.select("pair_id", f"{s}_ref").distinct(), ["pair_id", f"{s}_ref"], "left_anti")
        kinds = {"code": "string", "label": "string", "start": "decimal(38,0)", "end": "decimal(38,0)"}
        alone.append(rest.withColumns({f"{q}_{c}": F.lit(None).cast(k) for c, k in kinds.items()} | {"stage": F.lit(6), "sim": F.lit(None).cast("double"), f"{'res' if s == 'gt' else 'gt'}_ref": F.lit(None).cast("string")}))
    return scored(paired.unionByName(alone[0]).unionByName(alone[1]))


def scored(rows: DataFrame) -> DataFrame:
    """Numbers and similarities of matched rows (columns g_* and r_*, stage, sim)."""
    g, r = ({c: F.col(f"{p}_{c}") for c in ("code", "label", "start", "end")} for p in "gr")
    none = g["start"].isNull() & g["end"].isNull() & r["start"].isNull() & r["end"].isNull()
    number = N.number_similarity_with_codes(g["start"], r["start"], g["end"], r["end"], g["code"].isNotNull(), r["code"].isNotNull())
    number = F.when(F.col("stage") == 6, None).when((F.col("stage") == 1) & none, 1.0).otherwise(number)
    one = F.col("stage") == 6
    shown = lambda s, ref: F.when(ref.isNull(), "").otherwise(N.format_numbers(s["start"], s["end"], s["code"]))
    return rows.select(
        "pair_id",
        "stage",
        F.coalesce(g["label"], F.lit("")).alias("gt_label"),
        F.coalesce(r["label"], F.lit("")).alias("res_label"),
        shown(g, F.col("gt_ref")).alias("gt_numbers"),
        shown(r, F.col("res_ref")).alias("res_numbers"),
        F.col("sim").alias("label_sim"),
        number.alias("num_sim"),
        F.when(~one, N.overall_similarity(F.col("sim"), number)).alias("overall_sim"),
        F.when(~one, N.percent_difference(g["start"], r["start"])).alias("start_rel_diff_%"),
        F.when(~one, N.percent_difference(g["end"], r["end"])).alias("end_rel_diff_%"),
    )


def report_order(df: DataFrame) -> DataFrame:
    """Rows with both labels first, then by label."""
    both = (F.length("gt_label") > 0) & (F.length("res_label") > 0)
    return df.orderBy("pair_id", both.desc(), "gt_label", "res_label")


def pair_summary(rows: DataFrame) -> DataFrame:
    """Counts of rows by which side has a label, and means of the similarities that are there."""
    gt, res = F.length("gt_label") > 0, F.length("res_label") > 0
    return rows.groupBy("pair_id").agg(
        F.avg("overall_sim").alias("avg_over"),
        F.avg("label_sim").alias("avg_label"),
        F.avg("num_sim").alias("avg_num"),
        F.count("*").alias("rows_total"),
        F.count_if(gt & res).alias("paired_rows"),
        F.count_if(gt & ~res).alias("gt_only_rows"),
        F.count_if(~gt & res).alias("res_only_rows"),
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), "(?<=.)\\.[^.]*$", "")


def name_key(stem_col: Column) -> Column:
    """A file name without case, dashes and marks."""
    c = F.regexp_replace(nfkc_casefold(stem_col), "(?U)[\\s\\-_]+", " ")
    return F.regexp_replace(F.regexp_replace(F.trim(c), "(?U)[^\\p{L}\\p{N}_\\s]", " "), "(?U)\\s+", " ")


def slug(stem_col: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(without_marks(stem_col), "(?U)\\s+", "_"), "^_+|_+$", "")
    return F.substring(F.when(c == "", "report").otherwise(c), 1, 80)


def pair_tag(gt_name: Column, res_name: Column) -> Column:
    return F.substring(F.md5(F.concat(gt_name, F.lit("||"), res_name).cast("binary")), 1, 8)


def paired_files(gt: DataFrame, res: DataFrame) -> DataFrame:
    """gt_path, res_path, pair_reason. Names that agree pair first; the rest greedily by a score of letters and words.

    Of files with one name key on a side, the last by path counts. Columns: path.
    """
    def named(d: DataFrame, p: str) -> DataFrame:
        keyed = d.select("path", name_key(stem(F.col("path"))).alias("key")).groupBy("key").agg(F.max("path").alias(f"{p}_path"))
        return cut(keyed.withColumn(f"{p}_words", F.array_distinct(F.filter(F.split(name_key(stem(stem(F.col(f"{p}_path")))), "[^\\p{L}\\p{N}_]+"), lambda t: t != ""))))

    a, b = named(gt, "gt"), named(res, "res")
    exact = a.join(b, "key").select("gt_path", "res_path", F.lit("exact-stem").alias("pair_reason"))
    left, right = a.join(b.select("key"), "key", "left_anti"), b.join(a.select("key"), "key", "left_anti")
    # without a common word the score is at most 0.6: only such pairs are compared, and those without any word
    blocked = lambda d, p, key: d.select(F.col("key").alias(key), f"{p}_path", f"{p}_words", F.explode(F.when(F.size(f"{p}_words") > 0, F.col(f"{p}_words")).otherwise(F.array(F.lit("")))).alias("word"))
    pairs = blocked(left, "gt", "a").join(blocked(right, "res", "b"), "word").dropDuplicates(["gt_path", "res_path"])
    words = token_jaccard(F.col("gt_words"), F.col("res_words"))
    pairs = pairs.withColumn("tj", words).withColumn("score", 0.6 * sequence_ratio("a", "b") + 0.4 * F.col("tj"))
    good = pairs.filter((F.col("score") >= FILE_SCORE) | (F.col("tj") >= FILE_WORDS))
    fuzzy = mutual_best(good, "gt_path", "res_path", "score")
    return exact.unionByName(fuzzy.select("gt_path", "res_path", F.concat(F.lit("fuzzy:"), F.format_string("%.3f", "score")).alias("pair_reason")))


def numbered_pairs(pairs: DataFrame) -> DataFrame:
    """A folder name for each pair: its number, slug and tag."""
    at = F.row_number().over(Window.orderBy("gt_path", "res_path"))
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    return pairs.withColumn("folder", F.concat(F.format_string("%03d_", at), slug(stem(F.col("gt_path"))), F.lit("_"), pair_tag(name(F.col("gt_path")), name(F.col("res_path")))))
