"""Golden records: one row for each cluster of records, each field from the record that survives for it.

Records are range-partitioned and sorted by (cluster, RECENT), RECENT being latest first, then the more trusted
source, then the smaller id. So a cluster of any size is one run of rows over as many partitions as it needs. Three
steps follow, each over all partitions at once:

1. Heads: a partition tells the clusters it begins and ends with, with the latest time and the segment of each. The
   driver goes through them once in order, as a scan that starts anew where the cluster changes, and so learns the
   latest time and the segment of each cluster that spans partitions.
2. Folds: with those known, a partition folds each of its clusters into one row. A row of a spanning cluster is only
   a part; the driver gets its keys (numbers, no texts) and combines them by the same scan into which part wins each
   field.
3. The parts that win give their values; whole clusters are final already.

What the driver gets is two rows of fixed size a partition (segments travel as digests), so it depends on the number
of partitions, a parameter, and never on the rows. Executors may be lost: the sorted rows and the folds are written
tables, and every step is a plain read of them.

Defined cases: texts that are empty or hold only blanks are null; an unknown or null source has the least trust; a
null time is stale; rows without a cluster and an id are one cluster without an id (null). A balance that is NaN or infinite
is null. Records that agree in cluster, time, trust and id are ordered by their other columns, so repeated rows make no
difference but in the counts. An empty table gives no rows. Only the named columns are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_shuffles_early, written

#: Sources by falling trust.
TRUST = ("partner", "store", "web", "crm")
STALE_MICROS = 30 * 24 * 3600 * 1_000_000
BLANK = r"\A[\x20\x09-\x0D]*\z"
FIELDS = ("name", "email", "segment", "balance", "address")
#: A key is four numbers, the smaller the better: one or two of the field, then the rank by TRUSTED.
KEY = 4
FOLDED = (
    "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id long, balance double, "
    + ", ".join(f"{f}_from long" for f in FIELDS)
    + ", spans boolean, part long, at long, "
    + ", ".join(f"{f}_key array<long>" for f in FIELDS)
)


def _text(name: str) -> Column:
    return F.when(~F.col(name).rlike(BLANK), F.col(name))


def ordered(clients: DataFrame, partitions: int | None = None) -> DataFrame:
    """The records in order of (cluster, RECENT), written; ``part`` and ``at`` are a row's place."""
    spark = clients.sparkSession
    trust = F.lit(len(TRUST))
    for i, source in reversed(list(enumerate(TRUST))):
        trust = F.when(F.col("source") == source, i).otherwise(trust)
    amount = F.col("balance").cast("double")
    rows = clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), F.col("updated_at"), trust.alias("trust"), F.col("client_id").cast("long").alias("client_id"),
        *[_text(c).alias(c) for c in ("name", "email", "city", "segment")], F.col("nation_id").cast("long").alias("nation_id"),
        F.when(~F.isnan(amount) & (F.abs(amount) < float("inf")), amount).alias("balance"),
    )
    order = [F.col("cluster_id").asc_nulls_first(), F.col("updated_at").desc_nulls_last(), F.col("trust"), F.col("client_id").asc_nulls_last()]
    order += [F.col(c).asc_nulls_last() for c in ("name", "email", "city", "segment", "nation_id", "balance")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return written(rows.select(F.spark_partition_id().cast("long").alias("part"), place.alias("at"), "*"), "golden-order")


def _micros(column: pa.ChunkedArray | pa.Array) -> list[int | None]:
    return column.cast(pa.timestamp("us", tz=column.type.tz)).cast(pa.int64()).to_pylist()


def _digest(text: str | None) -> bytes | None:
    return None if text is None else hashlib.sha256(text.encode()).digest()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of a partition that this task reads: where it begins, and cluster, latest time and first segment at its two ends."""
    out, last = [], None
    for batch in batches:
        for part, at, cluster, updated, segment in zip(*(batch.column(i).to_pylist() for i in range(3)), _micros(batch.column(3)), batch.column(4).to_pylist()):
            if last is None or last[0] != part:
                last = [part, at, cluster, updated, None, cluster, updated, None]
                out.append(last)
            elif last[5] != cluster:
                last[5:] = [cluster, updated, None]
            if segment is not None and last[7] is None:
                last[7] = _digest(segment)
            if last[2] == last[5] and last[4] is None:
                last[4] = last[7]
    names = ["part", "at", "first", "first_latest", "first_segment", "end", "end_latest", "end_segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names)


HEADS = "part long, at long, first long, first_latest long, first_segment binary, end long, end_latest long, end_segment binary"


def spanning(heads: list) -> dict[int | None, tuple[int | None, bytes | None]]:
    """By cluster that goes on from one run to the next: its latest time and the digest of its segment."""
    out, before = {}, None
    for h in sorted(heads, key=lambda h: (h["part"], h["at"])):
        latest, segment = h["first_latest"], h["first_segment"]
        if before is not None and before[0] == h["first"]:
            latest = before[1]
            segment = before[2] if before[2] is not None else segment
            out[h["first"]] = (latest, segment)
        before = (h["end"], latest, segment) if h["first"] == h["end"] else (h["end"], h["end_latest"], h["end_segment"])
    return out


class _Fold:
    """One cluster's rows of one run, in order."""

    __slots__ = ("cluster", "latest", "wanted", "known", "spans", "n", "stale", "best", "value", "spare")

    def __init__(self, cluster, latest, wanted, spans):
        self.cluster, self.latest, self.wanted, self.spans = cluster, latest, wanted, spans
        self.known = spans  # whether wanted is the chosen segment's digest; else the first segment met is chosen
        self.n = self.stale = 0
        self.best, self.value, self.spare = dict.fromkeys(FIELDS), dict.fromkeys(FIELDS), None

    def offer(self, field, key, value):
        if self.best[field] is None or key < self.best[field]:
            self.best[field], self.value[field] = key, value

    def add(self, at, updated, trust, client, name, email, city, segment, nation, balance):
        stale = updated is None or self.latest - updated > STALE_MICROS
        self.n += 1
        self.stale += stale
        if segment is not None and self.best["segment"] is None:
            self.best["segment"], self.value["segment"] = (0, 0, 0, at), (segment, client)
            if not self.known:
                self.wanted, self.known = segment, True
        if email is not None:
            self.offer("email", (0, stale, trust, at), (email, client))
        if name is not None:
            self.offer("name", (-len(name), stale, trust, at), (name, client))
        if balance is not None:
            chosen = self.known and (segment is not None and (_digest(segment) if self.spans else segment) == self.wanted if self.wanted is not None else True)
            self.offer("balance", (not chosen, 0, 0, at), (balance, client))
        held = (city is not None) + (nation is not None)
        self.offer("address", (-held, stale, trust, at), (city, nation, client if held else None))

    def row(self, part, at):
        v, none = self.value, (None, None)
        city, nation, address_from = v["address"]
        pairs = [v[f] or none for f in ("name", "email", "segment", "balance")]
        values = [p[0] for p in pairs]
        keys = [None if self.best[f] is None else [int(k) for k in self.best[f]] for f in FIELDS]
        return [self.cluster, self.n, self.stale, *values[:3], city, nation, values[3], *[p[1] for p in pairs], address_from, self.spans, part, at, *(keys if self.spans else [None] * len(FIELDS))]


def fold(rows: DataFrame, spans: dict) -> DataFrame:
    """A row for each cluster of each run (``FOLDED``); those of spanning clusters are marked, and have their keys."""
    held = rows.sparkSession.sparkContext.broadcast(spans)  # two entries a partition at most, of fixed size
    names = [c.split()[0] for c in FOLDED.split(", ")]
    text, number = pa.string(), pa.int64()
    kinds = [number] * 3 + [text] * 4 + [number, pa.float64()] + [number] * 5 + [pa.bool_(), number, number] + [pa.list_(number)] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, now, where, done = held.value, None, None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)] + [_micros(batch.column(3))] + [batch.column(i).to_pylist() for i in range(4, 12)]
            for part, at, cluster, updated, *rest in zip(*columns):
                if now is None or now.cluster != cluster or where[0] != part:
                    if now is not None:
                        done.append(now.row(*where))
                    known = spans.get(cluster)
                    now, where = _Fold(cluster, *(known or (updated, None)), known is not None), (part, at)
                now.add(at, updated, *rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[now.row(*where)]), kinds)], names)

    return rows.mapInArrow(run, FOLDED)


def winners(parts: list) -> list[tuple]:
    """The segmented scan over the keys of spanning clusters' parts: by cluster, the counts and, by field, the (part, at)
    of the part that wins it."""
    out: dict = {}
    for r in sorted(parts, key=lambda r: (r["part"], r["at"])):
        now = out.setdefault(r["cluster_id"], [0, 0, {}])
        now[0] += r["n_records"]
        now[1] += r["n_stale"]
        for f in FIELDS:
            key = r[f"{f}_key"]
            if key is not None:
                # The run's place goes before the row's within it; segments come first in order, not by trust.
                mine = (*key[: KEY - 1], r["part"], key[KEY - 1])
                if f not in now[2] or mine < now[2][f][0]:
                    now[2][f] = (mine, r["part"], r["at"])
    return [(c, n, stale, *[x for f in FIELDS for x in won.get(f, (None, None, None))[1:]]) for c, (n, stale, won) in out.items()]


def golden(clients: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each cluster. partitions: of the range partitioning; the session's shuffle partitions if None."""
    spark = clients.sparkSession
    bounded_batches(spark)
    drop_shuffles_early(spark)
    rows = ordered(clients, partitions)
    heads = rows.select("part", "at", "cluster_id", "updated_at", "segment").mapInArrow(_heads, HEADS).collect()
    spans = spanning(heads)
    columns = ["part", "at", "cluster_id", "updated_at", "trust", "client_id", "name", "email", "city", "segment", "nation_id", "balance"]
    folded = written(fold(rows.select(*columns), spans), "golden-folds")
    keys = folded.where("spans").select("cluster_id", "part", "at", "n_records", "n_stale", *[f"{f}_key" for f in FIELDS]).collect()
    won = spark.createDataFrame(winners(keys), "w_cluster long, w_records long, w_stale long, " + ", ".join(f"{f}_part long, {f}_at long" for f in FIELDS))
    joined = folded.where("spans").join(F.broadcast(won), F.col("cluster_id").eqNullSafe(F.col("w_cluster")))

    def of(field: str, *names: str) -> list[Column]:
        mine = (F.col("part") == F.col(f"{field}_part")) & (F.col("at") == F.col(f"{field}_at"))
        return [F.max(F.when(mine, F.col(n))).alias(n) for n in names]

    taken = [c for f in FIELDS for c in of(f, *(("city", "nation_id") if f == "address" else (f,)), f"{f}_from")]
    merged = joined.groupBy("cluster_id").agg(F.max("w_records").alias("n_records"), F.max("w_stale").alias("n_stale"), *taken)
    out = ["cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", *[f"{f}_from" for f in FIELDS]]
    cents = F.floor(F.lit(100.0) * F.col("balance") + F.lit(0.5)).cast("long").alias("balance_cents")
    made = folded.where(~F.col("spans")).select(*out).unionByName(merged.select(*out))
    kind = clients.schema["nation_id"].dataType
    return made.select(*[F.col(c).cast(kind) if c == "nation_id" else F.col(c) for c in out if c != "balance"], cents)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark.read.parquet(f"{sf_dir}/clients.parquet"))


def oracle() -> str:
    """The same by window functions."""
    text = lambda c: f"CASE WHEN NOT regexp_full_match({c}, '[\\x20\\x09-\\x0D]*') THEN {c} END AS {c}"
    recent = "u DESC NULLS LAST, trust, client_id NULLS LAST, name NULLS LAST, email NULLS LAST, city NULLS LAST, segment NULLS LAST, nation_id NULLS LAST, balance NULLS LAST"
    trusted = f"stale, trust, {recent}"
    trust = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(TRUST)) + f" ELSE {len(TRUST)} END"
    pick = lambda c, order, where: f"first({c} ORDER BY {order}) FILTER (WHERE {where})"
    return f"""
    WITH a AS (
        SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at AS u, {trust} AS trust, {text("name")}, {text("email")}, {text("city")},
            {text("segment")}, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance
        FROM clients
    ), b AS (
        SELECT *, u IS NULL OR max(u) OVER (PARTITION BY cluster_id) - u > INTERVAL '{30 * 24} hours' AS stale FROM a
    ), c AS (
        SELECT *, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, {recent} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS chosen,
            (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS held
        FROM b
    )
    SELECT cluster_id, count(*) AS n_records, sum(stale::INT)::BIGINT AS n_stale,
        {pick("name", "length(name) DESC, " + trusted, "name IS NOT NULL")} AS name, {pick("email", trusted, "email IS NOT NULL")} AS email,
        max(chosen) AS segment,
        (first(struct_pack(v := city) ORDER BY held DESC, {trusted})).v AS city, (first(struct_pack(v := nation_id) ORDER BY held DESC, {trusted})).v AS nation_id,
        floor(100.0 * {pick("balance", "segment IS DISTINCT FROM chosen, " + recent, "balance IS NOT NULL")} + 0.5)::BIGINT AS balance_cents,
        (first(struct_pack(v := client_id) ORDER BY length(name) DESC, {trusted}) FILTER (WHERE name IS NOT NULL)).v AS name_from,
        (first(struct_pack(v := client_id) ORDER BY {trusted}) FILTER (WHERE email IS NOT NULL)).v AS email_from,
        (first(struct_pack(v := client_id) ORDER BY {recent}) FILTER (WHERE segment IS NOT NULL)).v AS segment_from,
        (first(struct_pack(v := client_id) ORDER BY segment IS DISTINCT FROM chosen, {recent}) FILTER (WHERE balance IS NOT NULL)).v AS balance_from,
        (first(struct_pack(v := client_id) ORDER BY held DESC, {trusted}) FILTER (WHERE held > 0)).v AS address_from
    FROM c GROUP BY cluster_id
    """
