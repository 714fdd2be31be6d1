"""Mixing sources to target shares of tokens, with capped repetition.

Equal texts of several sources can serve any of them, so texts are grouped by the set of sources that hold them, their
membership pattern. A min-cost flow routes the patterns' tokens to the sources' quotas: each further use of a text
costs more, so repetition is spread, and the total is the largest for which every quota can be met. Texts are then
taken in a seeded order: a pattern's texts lie on a line by their tokens, each source's share is a stretch of the
line wound round as often as needed, and a text is used as often as the stretch passes its beginning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window

from noticeloom.llm.tokens import TOKENIZER_DIR, VOCABULARY, token_counts
from noticeloom.session import materialise

#: Texts a bucket of the seeded order holds about.
#: Sets of sources that texts may be in; their sums go to the driver.
MAX_PATTERNS = 100_000
PER_BUCKET = 50_000


@dataclass
class _Edge:
    to: int
    room: float
    cost: float
    back: int


class Flow:
    """Min-cost flow by successive cheapest paths; for graphs of some hundred edges."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[_Edge]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: float, cost: float = 0.0) -> tuple[int, int]:
        self.edges[a].append(_Edge(b, room, cost, len(self.edges[b])))
        self.edges[b].append(_Edge(a, 0.0, -cost, len(self.edges[a]) - 1))
        return a, len(self.edges[a]) - 1

    def run(self, source: int, sink: int, tiny: float = 1e-10) -> float:
        sent = 0.0
        while True:
            best = [float("inf")] * len(self.edges)
            came: list[tuple[int, int] | None] = [None] * len(self.edges)
            best[source], queue = 0.0, [source]
            while queue:
                later = []
                for a in queue:
                    for i, e in enumerate(self.edges[a]):
                        if e.room > tiny and best[a] + e.cost < best[e.to] - 1e-12:
                            best[e.to], came[e.to] = best[a] + e.cost, (a, i)
                            later.append(e.to)
                queue = list(dict.fromkeys(later))
            if came[sink] is None:
                return sent
            path, at = [], sink
            while at != source:
                path.append(came[at])
                at = came[at][0]
            step = min(self.edges[a][i].room for a, i in path)
            for a, i in path:
                e = self.edges[a][i]
                e.room -= step
                self.edges[e.to][e.back].room += step
            sent += step


def plan_flow(capacity: dict[tuple[str, ...], float], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """(total, tokens by pattern and source): the largest total that meets all shares, with the least repetition.

    capacity: tokens of the distinct texts of each pattern. targets: share and repeats of each source. A source without
    tokens gets none and the shares of the others are scaled up to 1.
    """
    shares = {s: share for s, (share, _) in targets.items() if share > 0 and any(s in p and n > 0 for p, n in capacity.items())}
    if not shares:
        return 0.0, {}
    size = sum(capacity.values())  # in parts of the whole, so that one tolerance fits every size
    total, sent = _plan({p: n / size for p, n in capacity.items()}, targets, shares)
    return total * size, {k: x * size for k, x in sent.items()}


def _plan(capacity: dict, targets: dict, shares: dict) -> tuple[float, dict]:
    whole = sum(shares.values())
    shares = {s: x / whole for s, x in shares.items()}
    patterns = [p for p, n in capacity.items() if n > 0 and any(s in shares for s in p)]
    names = list(shares)

    def build(total: float):
        f = Flow(2 + len(patterns) + len(names))
        routes = {}
        for i, p in enumerate(patterns):
            most = max(targets[s][1] for s in p if s in shares)
            for use in range(1, most + 1):  # the cost of the k-th use grows with k
                f.add(0, 2 + i, capacity[p], float(use * use))
            for s in p:
                if s in shares:
                    routes[p, s] = f.add(2 + i, 2 + len(patterns) + names.index(s), capacity[p] * targets[s][1])
        for j, s in enumerate(names):
            f.add(2 + len(patterns) + j, 1, total * shares[s])
        return f, routes

    low, high = 0.0, min(sum(capacity[p] for p in patterns if s in p) * targets[s][1] / shares[s] for s in names)
    for _ in range(40):
        middle = (low + high) / 2
        if build(middle)[0].run(0, 1) >= middle * (1 - 1e-7):
            low = middle
        else:
            high = middle
        if high - low <= 1e-7 * high:
            break
    f, routes = build(low)
    f.run(0, 1)
    sent = {}
    for (p, s), (a, i) in routes.items():
        e = f.edges[a][i]
        if (x := f.edges[e.to][e.back].room) > 0:
            sent[p, s] = x
    return low, sent


def counted_texts(documents: DataFrame, name: str = VOCABULARY, directory: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source, text_id and n_tokens of each document with tokens; text_id is equal for equal texts.

    Null and empty texts and documents without source have no part; a repeated doc_id counts once, of differing rows the smallest text.
    """
    docs = documents.where("text <> '' AND source IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("d"))
    docs = docs.select("doc_id", "d.source", "d.text")
    return token_counts(docs.withColumn("text_id", F.unhex(F.sha2("text", 256))), name=name, directory=directory).drop("text")


def mixed(documents: DataFrame, mix_targets: DataFrame, seed: int = 17, name: str = VOCABULARY, directory: str = TOKENIZER_DIR, merge_copies: bool = True) -> DataFrame:
    """doc_id, source, n_tokens and repeats: how often each chosen record is used, by the source that it counts for.

    Of equal texts in one source the smallest doc_id stands for all; a text is used at most max_repeats times for each
    source and the largest max_repeats of its sources altogether. With merge_copies False each record stands for itself.
    mix_targets has a row a source (a fixed small table); sets of sources over MAX_PATTERNS are refused.
    """
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in mix_targets.dropDuplicates(["source"]).where("target_share IS NOT NULL AND max_repeats > 0").collect()}
    rows = materialise(counted_texts(documents, name, directory).where(F.col("source").isin(list(goals))), "mix-tokens")
    if not merge_copies:
        rows = rows.withColumn("text_id", F.unhex(F.sha2(F.concat(F.hex("text_id"), F.col("doc_id").cast("string")), 256)))
    records = rows.groupBy("text_id", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = records.groupBy("text_id").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("n_tokens").alias("n_tokens"), F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
    texts = materialise(texts.withColumn("order", F.xxhash64("text_id", F.lit(seed))), "mix-texts")
    sums = texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()  # a row a set of sources
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources hold texts")
    total, sent = plan_flow({tuple(r["pattern"]): float(r["tokens"]) for r in sums}, goals)
    buckets = max(16, sum(r["n"] for r in sums) // PER_BUCKET)
    placed = _placed(texts, int(buckets))
    stretches = []
    for r in sums:
        at = 0.0
        for s in r["pattern"]:
            if x := sent.get((tuple(r["pattern"]), s)):
                stretches.append((list(r["pattern"]), s, at, at + x, float(r["tokens"])))
                at += x
    plan = documents.sparkSession.createDataFrame(stretches, "pattern array<string>, source string, start double, stop double, round double")
    laps = lambda x: F.ceil((F.col(x) - F.col("at")) / F.col("round"))
    used = placed.join(plan, "pattern").withColumn("repeats", (F.greatest(laps("stop"), F.lit(0)) - F.greatest(laps("start"), F.lit(0))).cast("int"))
    if goals:
        caps = F.create_map(*[F.lit(x) for s, (_, n) in goals.items() for x in (s, n)])
        used = used.withColumn("repeats", F.least("repeats", F.element_at(caps, F.col("source"))))
    return used.where("repeats > 0").select(F.element_at("docs", F.col("source")).alias("doc_id"), "source", "n_tokens", "repeats")


def _placed(texts: DataFrame, buckets: int) -> DataFrame:
    """Adds at, the tokens of the pattern's texts that come before in the seeded order.

    The order is cut into buckets of bounded size; sums of buckets give each bucket's start, so that no window holds
    more than a bucket or the list of buckets.
    """
    t = texts.withColumn("rank", F.expr("shiftrightunsigned(order, 11)"))
    t = t.withColumn("bucket", F.floor(F.col("rank") / F.lit(float(1 << 53)) * buckets).cast("int"))
    sizes = t.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("pattern", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("rank", "text_id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sizes, ["pattern", "bucket"])
    return t.select("pattern", "docs", "n_tokens", (F.col("start") + F.col("within")).cast("double").alias("at"))


def shares(mix: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Each source's target and actual share of the mixed tokens, its records, uses and most uses of one."""
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_records"), F.sum("repeats").cast("bigint").alias("n_uses"), F.max("repeats").alias("most_uses")
    )
    every = Window.partitionBy(F.lit(1))  # one row a source
    rows = mix_targets.dropDuplicates(["source"]).join(got, "source", "left").fillna(0, ["n_tokens", "n_records", "n_uses", "most_uses"]).withColumn("whole", F.sum("n_tokens").over(every))
    return rows.select("source", "target_share", F.round(F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), "n_tokens", "n_records", "n_uses", "most_uses", "max_repeats")
