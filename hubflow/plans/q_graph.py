"""Graph-learning queries: collapsed digraph, walks, walk embeddings,
embedding joins, k-hop neighbour features, edge representations and the
feature-augmented regressors."""

from __future__ import annotations

from pyspark.sql import functions as F

from hubflow.operators import corridors as C
from hubflow.operators import graph as G
from hubflow.operators import hubs as H
from hubflow.operators import metrics as M
from hubflow.operators import models as ML
from hubflow.operators import neighbourhood as NB
from hubflow.operators import splits as SP
from hubflow.operators import skipgram as SG
from hubflow.operators import walks as W
from hubflow.plans import sqltext as S
from hubflow.plans.common import features, memo, training_table
from hubflow.plans.registry import query
from hubflow.sources.trips import hub_vectors


def multigraph(spark, sf):
    """(vertices, stratified edges) of the training multigraph."""
    def build_e():
        return C.edge_weights(training_table(spark, sf))
    e = memo(spark, sf, "edge_weights", build_e)
    v = memo(spark, sf, "multigraph_vertices", lambda: H.hub_features(training_table(spark, sf)).join(
        G.vertices_of(e, "source_center", "destination_center").withColumnRenamed("v", "hub_id"), "hub_id", "full"))
    return v, e


def collapsed(spark, sf):
    v, e = multigraph(spark, sf)
    return v, G.collapse(e, "source_center", "destination_center", "edge_weight", how="min")


@query("collapse_min", f"""with {S.EDGES}
select source_center as src, destination_center as dst, min(coalesce(edge_weight, 1.0)) as weight
from edges where edge_weight is not null group by 1, 2""")
def q_collapse(spark, sf):
    return collapsed(spark, sf)[1]


@query("multigraph_vertices", f"""with {S.EDGES}{S.HUBS_TAIL}
select coalesce(h.hub_id, x.hub_id) as hub_id, outbound_trips, inbound_trips, unique_destinations, unique_sources
from hubs h full outer join (select source_center hub_id from edges union select destination_center from edges) x
  on h.hub_id = x.hub_id""")
def q_multigraph_vertices(spark, sf):
    v, _ = multigraph(spark, sf)
    return v.select("hub_id", "outbound_trips", "inbound_trips", "unique_destinations", "unique_sources")


@query("top_hub_successors", f"""with {S.EDGES},
deg as (select source_center, count(*) as k from edges group by 1),
top as (select arg_max(source_center, (k, source_center)) as hub from deg)
select distinct source_center as hub_id, destination_center as successor from edges, top where source_center = top.hub""")
def q_top_hub_successors(spark, sf):
    _, e = multigraph(spark, sf)
    deg = e.groupBy("source_center").agg(F.count(F.lit(1)).alias("k"))
    top = deg.agg(F.max_by("source_center", F.struct("k", "source_center")).alias("hub_id"))
    return (e.join(F.broadcast(top), F.col("source_center") == F.col("hub_id"))  # one row
            .select("hub_id", F.col("destination_center").alias("successor")).distinct())


def walks(spark, sf):
    def build():
        v, e = collapsed(spark, sf)
        return W.random_walks(e, v.select(F.col("hub_id").alias("v")), num_walks=200, walk_length=30,
                              p=1.0, q=0.5, seed=42)
    return memo(spark, sf, "walks", build)


WALKS_SQL = f"""with recursive {S.EDGES}{S.HUBS_TAIL},
col as (select source_center as src, destination_center as dst, min(coalesce(edge_weight, 1.0)) as w
  from edges where edge_weight is not null group by 1, 2),
vs as (select hub_id, row_number() over (order by hub_id) - 1 as num from
  (select hub_id from hubs union select source_center from edges union select destination_center from edges)),
cum as (select src, dst, sum(w) over (partition by src order by dst) as hi from col),
edge as (select src, dst, hi, coalesce(lag(hi) over (partition by src order by dst), 0.0) as lo, max(hi) over (partition by src) as total from cum),
w as (select num * 200 + i as walker, hub_id || ':' || i as walk_id, hub_id as start, 1 as step, 0 as attempt, cast(null as varchar) as back, hub_id as cur,
    hub_id as walk from vs, range(200) r(i)
  union all
  select walker, walk_id, start, step + cast(ok as integer), case when ok then 0 else attempt + 1 end, case when ok then cur else back end,
    case when ok then dst else cur end, case when ok then walk || ' ' || dst else walk end from (
    select w.*, e.dst, w.back is null or {W.draw_sql('walker', 'step', 'attempt', 1, 42)} * 2.0
      < case when e.dst = w.back then 1.0 when b.src is not null then 1.0 else 2.0 end as ok
    from (select *, {W.draw_sql('walker', 'step', 'attempt', 0, 42)} as u from w where step < 30) w
    join edge e on e.src = w.cur and u * e.total >= e.lo and u * e.total < e.hi
    left join col b on b.src = w.back and b.dst = e.dst))
select walk_id, start, cast(step as integer) as length, walk
from (select *, row_number() over (partition by walker order by step desc, attempt desc) as last from w) where last = 1"""


@query("walks", WALKS_SQL)
def q_walks(spark, sf):
    return walks(spark, sf).select("walk_id", "start", F.size("walk").alias("length"),
                                   F.array_join("walk", " ").alias("walk"))


def walk_vectors(spark, sf):
    return memo(spark, sf, "walk_embeddings", lambda: SG.skipgram(walks(spark, sf), dim=64, window=10, min_count=1, epochs=5, negative=5, seed=42))


@query("walk_pairs", f"""with ws as ({WALKS_SQL}),
tok as (select walk_id, unnest(string_split(walk, ' ')) as hub, generate_subscripts(string_split(walk, ' '), 1) as pos from ws)
select a.hub as center, b.hub as context, cast(sum(11 - abs(a.pos - b.pos)) as bigint) as weight
from tok a join tok b on a.walk_id = b.walk_id and a.pos <> b.pos and abs(a.pos - b.pos) <= 10 group by all""")
def q_walk_pairs(spark, sf):
    return SG.window_pairs(walks(spark, sf), 10)


@query("walk_tokens", f"""with ws as ({WALKS_SQL}) select hub_id, count(*) as n
from (select unnest(string_split(walk, ' ')) as hub_id from ws) group by 1""")
def q_walk_tokens(spark, sf):
    return SG.token_counts(walks(spark, sf))


@query("word2vec_hubs")
def q_word2vec(spark, sf):
    return walk_vectors(spark, sf)


@query("walk_embedding_health")
def q_walk_health(spark, sf):
    return W.embedding_health_summary(W.embedding_health(walk_vectors(spark, sf)))


@query("embedding_health", """select dim - 1 as dim, round(var_pop(x), 12) as variance, var_pop(x) < 1e-6 as dead
from (select unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as dim
      from embeddings) group by dim""")
def q_embedding_health(spark, sf):
    h = W.embedding_health(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return h.withColumn("variance", F.round("variance", 12)).withColumn("dim", F.col("dim").cast("bigint"))


@query("embedding_health_summary", """with h as (select dim, var_pop(x) as variance
  from (select unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) as dim
        from embeddings) group by dim)
select count(*) as dims, round(min(variance), 12) as min_variance, round(avg(variance), 12) as mean_variance,
  round(max(variance), 12) as max_variance, count(*) filter (where variance < 1e-6) as dead_dims from h""")
def q_embedding_health_summary(spark, sf):
    s = W.embedding_health_summary(W.embedding_health(spark.read.parquet(f"{sf}/embeddings.parquet")))
    return s.withColumns({c: F.round(c, 12) for c in ("min_variance", "mean_variance", "max_variance")})


_HV = """hv as (select printf('HUB%02d', vec_id) as hub_id,
  cast(embedding as double[]) as emb from embeddings)"""


def emb_joined(spark, sf):
    hv = hub_vectors(spark, sf)
    return NB.embedding_join(features(spark, sf), hv, dim=64)


@query("embedding_join", f"""with {S.FEAT}, {_HV}
select f.row_ord, s.hub_id is not null as src_known, d.hub_id is not null as dst_known,
  round(coalesce(list_sum(s.emb), 0.0), 6) as src_emb_sum, round(coalesce(list_sum(d.emb), 0.0), 6) as dst_emb_sum,
  coalesce(len(s.emb), 64) as src_dim
from feat f left join hv s on s.hub_id = f.source_center left join hv d on d.hub_id = f.destination_center""")
def q_embedding_join(spark, sf):
    j = emb_joined(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return j.select("row_ord", "src_known", "dst_known", F.round(total(F.col("src_emb")), 6).alias("src_emb_sum"),
                    F.round(total(F.col("dst_emb")), 6).alias("dst_emb_sum"),
                    F.size("src_emb").cast("bigint").alias("src_dim"))


_LATE = """slow as (select source_center as hub from feat group by 1 having avg(factor) > (select avg(factor) from feat)),
lv as (select hv.* from hv join slow on hub_id = hub)"""


def late_joined(spark, sf):
    """Only hubs whose mean factor is above that of all trips have a vector yet."""
    f = features(spark, sf)
    mean = f.agg(F.avg("factor").alias("all"))
    slow = f.groupBy(F.col("source_center").alias("hub_id")).agg(F.avg("factor").alias("own")).join(F.broadcast(mean), F.col("own") > F.col("all"))  # one row
    return NB.embedding_join(f, hub_vectors(spark, sf).join(slow.select("hub_id"), "hub_id", "left_semi"), dim=64)


@query("embedding_join_late", f"""with {S.FEAT}, {_HV}, {_LATE}
select f.row_ord, s.hub_id is not null as src_known, d.hub_id is not null as dst_known,
  round(coalesce(list_sum(s.emb), 0.0), 6) as src_emb_sum, round(coalesce(list_sum(d.emb), 0.0), 6) as dst_emb_sum
from feat f left join lv s on s.hub_id = f.source_center left join lv d on d.hub_id = f.destination_center""")
def q_embedding_join_late(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return late_joined(spark, sf).select("row_ord", "src_known", "dst_known", F.round(total(F.col("src_emb")), 6).alias("src_emb_sum"),
                                         F.round(total(F.col("dst_emb")), 6).alias("dst_emb_sum"))


@query("embedding_coverage_late", f"""with {S.FEAT}, {_HV}, {_LATE},
k as (select case when s.hub_id is not null then 1.0 else 0.0 end as a, case when d.hub_id is not null then 1.0 else 0.0 end as b
  from feat f left join lv s on s.hub_id = f.source_center left join lv d on d.hub_id = f.destination_center)
select count(*) as rows, avg(a) * 100 as src_coverage_pct, avg(b) * 100 as dst_coverage_pct, avg(a) * 100 < 90 or avg(b) * 100 < 90 as warning from k""")
def q_embedding_coverage_late(spark, sf):
    return NB.embedding_coverage(late_joined(spark, sf))


@query("embedding_coverage", f"""with {S.FEAT}, {_HV}
select count(*) as rows, avg(case when s.hub_id is not null then 1.0 else 0.0 end) * 100 as src_coverage_pct,
  avg(case when d.hub_id is not null then 1.0 else 0.0 end) * 100 as dst_coverage_pct,
  avg(case when s.hub_id is not null then 1.0 else 0.0 end) * 100 < 90
    or avg(case when d.hub_id is not null then 1.0 else 0.0 end) * 100 < 90 as warning
from feat f left join hv s on s.hub_id = f.source_center left join hv d on d.hub_id = f.destination_center""")
def q_embedding_coverage(spark, sf):
    return NB.embedding_coverage(emb_joined(spark, sf))


def _x_sql():
    parts = " union all ".join(
        f"select a.hub_id, {i} as dim, coalesce(cast(h.{c} as double), 0.0) as value from hubs_all a "
        f"left join hubs h using (hub_id)" for i, c in enumerate(NB.NODE_FEAT_COLS))
    return parts


NEIGH_SQL = f"""with {S.FEAT}{S.HUBS_TAIL},
hubs_all as (select source_center as hub_id from feat union select destination_center from feat),
x as ({_x_sql()}),
ec as (select source_center src, destination_center dst, count(*) c from feat group by 1, 2),
m1 as (select ec.dst hub_id, x.dim, sum(c * value) / sum(c) value from ec join x on x.hub_id = ec.src group by 1, 2),
h1 as (select * from x union all select a.hub_id, d.dim + 10, coalesce(m1.value, 0.0) from hubs_all a
  cross join range(10) d(dim) left join m1 on m1.hub_id = a.hub_id and m1.dim = d.dim),
m2 as (select ec.dst hub_id, h1.dim, sum(c * value) / sum(c) value from ec join h1 on h1.hub_id = ec.src group by 1, 2),
h2 as (select * from h1 union all select a.hub_id, d.dim + 20, coalesce(m2.value, 0.0) from hubs_all a
  cross join range(20) d(dim) left join m2 on m2.hub_id = a.hub_id and m2.dim = d.dim)"""


def hub_h2(spark, sf):
    def build():
        f = features(spark, sf)
        hubs = H.hub_inventory(f)
        x = NB.hub_matrix(hubs, H.hub_features(training_table(spark, sf)))
        return NB.neighbour_mean(x, NB.trip_edges(f), hops=2)
    return memo(spark, sf, "neighbour_mean", build)


@query("neighbour_mean", NEIGH_SQL + """
select hub_id, cast(dim as integer) as dim, round(value, 8) as value from h2""")
def q_neighbour_mean(spark, sf):
    return hub_h2(spark, sf).withColumn("value", F.round("value", 8)).withColumn("dim", F.col("dim").cast("int"))


def edge_table(spark, sf):
    f = features(spark, sf).withColumn("is_train", F.col("data") == "training")
    idx = H.hub_index(H.hub_inventory(f))
    e = SP.val_tail(NB.edge_features(f), frac=0.1)
    return (e.join(idx.select(F.col("hub_id").alias("source_center"), F.col("hub_index").alias("src_idx")),
                   "source_center")
            .join(idx.select(F.col("hub_id").alias("destination_center"), F.col("hub_index").alias("dst_idx")),
                  "destination_center"))


@query("edge_features", f"""with {S.FEAT},
hidx as (select hub_id, row_number() over (order by hub_id) - 1 as idx from
  (select source_center as hub_id from feat union select destination_center from feat)),
t as (select *, row_number() over (order by trip_creation_time, row_ord) - 1 as p, count(*) over () as n
  from feat where data = 'training'),
sp as (select row_ord, case when p >= n - greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from t
  union all select row_ord, 'test' from feat where data <> 'training')
select f.row_ord, s.idx as src_idx, d.idx as dst_idx, osrm_time, round(ln(1 + greatest(osrm_time, 0.0)), 10) as log_osrm_time,
  round(ln(1 + greatest(actual_distance_to_destination, 0.0)), 10) as log_distance,
  round(ln(1 + greatest(start_scan_to_end_scan, 0.0)), 10) as log_dwell, hour_of_day, day_of_week,
  cast(case time_of_day when 'Night_0_6' then 0 when 'Morning_6_10' then 1 when 'Afternoon_10_16' then 2
    when 'Evening_16_20' then 3 when 'Night_20_24' then 4 end as integer) as time_of_day_code,
  cast(route_type = 'FTL' as integer) as route_type_enc, cast(is_cutoff as integer) as is_cutoff_int,
  actual_time, sp.split
from feat f join sp using (row_ord) join hidx s on s.hub_id = f.source_center join hidx d on d.hub_id = f.destination_center""")
def q_edge_features(spark, sf):
    e = edge_table(spark, sf)
    return e.select("row_ord", "src_idx", "dst_idx", "osrm_time", *[F.round(c, 10).alias(c) for c in
                    ("log_osrm_time", "log_distance", "log_dwell")], "hour_of_day", "day_of_week",
                    "time_of_day_code", "route_type_enc", "is_cutoff_int", "actual_time", "split")


@query("edge_representation", NEIGH_SQL + """,
vs as (select hub_id, sum(value) as s, count(*) as k from h2 group by 1)
select f.row_ord, cast(vs1.k + vs2.k + 9 as integer) as rep_len,
  round(vs1.s + vs2.s + osrm_time + ln(1 + greatest(osrm_time, 0.0)) + ln(1 + greatest(actual_distance_to_destination, 0.0))
    + ln(1 + greatest(start_scan_to_end_scan, 0.0)) + hour_of_day + day_of_week
    + case time_of_day when 'Night_0_6' then 0 when 'Morning_6_10' then 1 when 'Afternoon_10_16' then 2
      when 'Evening_16_20' then 3 when 'Night_20_24' then 4 end
    + case when route_type = 'FTL' then 1 else 0 end + case when is_cutoff then 1 else 0 end, 6) as rep_sum
from feat f join vs vs1 on vs1.hub_id = f.source_center join vs vs2 on vs2.hub_id = f.destination_center""")
def q_edge_representation(spark, sf):
    vec = NB.to_vectors(hub_h2(spark, sf))
    rep = NB.edge_representation(NB.edge_features(features(spark, sf)), vec)
    return rep.select("row_ord", F.size("representation").alias("rep_len"),
                      F.round(F.aggregate("representation", F.lit(0.0), lambda a, x: a + x), 6).alias("rep_sum"))


# ---------------------------------------------------------------------------
# Feature-augmented regressors (rows-only)
# ---------------------------------------------------------------------------
_HYBRID: dict = {}


def hybrid_model(spark, sf):
    """(model, test rows): boosted trees on the base features plus source/destination walk embeddings; hubs without one have zeros."""
    from hubflow.plans.q_models import encoded
    key = (spark.sparkContext.applicationId, sf)
    if key not in _HYBRID:
        emb = walk_vectors(spark, sf).select("hub_id", F.col("embedding").cast("array<double>").alias("__v"))
        zero = F.array_repeat(F.lit(0.0), 64)

        def aug(df):
            s = emb.select(F.col("hub_id").alias("source_hub_id"), F.col("__v").alias("src_emb"))
            d = emb.select(F.col("hub_id").alias("dest_hub_id"), F.col("__v").alias("dst_emb"))
            out = df.join(s, "source_hub_id", "left").join(d, "dest_hub_id", "left")
            return out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("src_emb", "dst_emb")})
        tr, te = map(aug, encoded(spark, sf))
        _HYBRID[key] = ML.search_eta_model(tr, ML.feature_columns(), space=ML.HYBRID_SPACE, vector_cols=("src_emb", "dst_emb")), te
    return _HYBRID[key]


@query("hybrid_eta")
def q_hybrid_eta(spark, sf):
    """Boosted trees on the base features plus source/destination walk embeddings."""
    model, te = hybrid_model(spark, sf)
    return M.prediction_table(ML.predict(model, te, keep=("trip_id", "row_ord")))


@query("hybrid_top_features")
def q_hybrid_top_features(spark, sf):
    """The hybrid's fifteen inputs with the largest share of the gain."""
    return ML.importances(hybrid_model(spark, sf)[0], spark).where("rank <= 15")


@query("hybrid_embedding_share")
def q_hybrid_embedding_share(spark, sf):
    """Share of the gain by group of inputs: the base features and the two embeddings."""
    return ML.group_shares(ML.importances(hybrid_model(spark, sf)[0], spark))


@query("neighbour_eta")
def q_neighbour_eta(spark, sf):
    """Boosted trees on [2-hop neighbour features of both ends ‖ trip edge features]; positive output."""
    vec = NB.to_vectors(hub_h2(spark, sf)).select("hub_id", F.col("vector").cast("array<double>").alias("__v"))
    e = edge_table(spark, sf)
    e = (e.join(vec.select(F.col("hub_id").alias("source_center"), F.col("__v").alias("src_vec")), "source_center")
         .join(vec.select(F.col("hub_id").alias("destination_center"), F.col("__v").alias("dst_vec")),
               "destination_center")
         .withColumnRenamed("actual_time", "actual_eta"))
    tr = e.filter(F.col("split") == "train")
    te = e.filter(F.col("split") == "test")
    model = ML.search_eta_model(tr, NB.EDGE_FEAT_COLS, vector_cols=("src_vec", "dst_vec"))
    return M.prediction_table(ML.predict(model, te, keep=("row_ord",), positive=True))


@query("order_components", """select 'c' || o_custkey as component, 1 + count(*) as size from orders
where o_custkey is not null group by o_custkey""")
def q_order_components(spark, sf):
    """Weak components of the customer-order graph over the whole table: one for each customer with orders."""
    o = spark.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_custkey").isNotNull())
    edges = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                     F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return G.component_sizes(G.weak_components(edges))
