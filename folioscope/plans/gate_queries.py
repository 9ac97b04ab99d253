"""Queries of candidate gates, rule sweeps, picks, stacked blends and anchors, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import metrics as me
from folioscope.operators import ordinal as od
from folioscope.operators.ranking import top_per_group
from folioscope.plans.base import CUTS, FOLDS_SQL, LONG_SQL, PAPERS_SQL, TESTS_SQL, clip, held_out, long_scores, papers, with_folds
from folioscope.plans.ordinal_queries import MET, P, PF, PL, r6
from folioscope.sources.cache import read_if_exists
from folioscope.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NAMES = ("s1", "s2", "s3", "s4")


def query(name: str, sql: str | None = None):
    """Registers a query beside its SQL."""

    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def _pred_sql(score: str) -> str:
    return "(1+" + "+".join(f"({score}>={c}::double)::int" for c in CUTS) + ")"


# candidates: neighbours of base weights, one knob moved, without repeats

BASES = [(0.5, 0.2, 0.2, 0.1), (0.4, 0.3, 0.2, 0.1), (0.25, 0.25, 0.25, 0.25)]
MOVES = (-0.1, -0.05, 0.05, 0.1)
MOST_LAST = 0.2  # the cap of the last score's weight
_W = [f"w{i}" for i in range(1, 5)]
_NEIGHBOURS = (
    "base(b1,b2,b3,b4) as (values " + ",".join(str(b) for b in BASES) + "), moved as (select b1 as w1,b2 as w2,b3 as w3,b4 as w4 from base union all select "
    + ",".join(f"greatest(0.0,b{i}+case when k={i} then m else 0.0 end)" for i in range(1, 5))
    + " from base cross join (select unnest([1,2,3,4]) as k) cross join (values " + ",".join(f"({m})" for m in MOVES) + ") v(m)), "
    + "grid as (select distinct round(w1::double/t,4) as w1, round(w2::double/t,4) as w2, round(w3::double/t,4) as w3, round(w4::double/t,4) as w4 from (select *, (w1+w2+w3+w4)::double as t from moved) where t>0), "
    + f"kept as (select w1,w2,w3,w4, concat_ws('/',printf('%.4f',w1),printf('%.4f',w2),printf('%.4f',w3),printf('%.4f',w4)) as name from grid where abs(w1+w2+w3+w4-1)<=0.0003 and w4<={MOST_LAST})"
)


def neighbours(spark: SparkSession) -> DataFrame:
    """(name, w1…w4): the base weights and those with one knob moved, of sum 1, rounded, under the cap of the last, each once."""
    base = spark.createDataFrame(BASES, "b1 double, b2 double, b3 double, b4 double")
    knob, move = F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"), F.explode(F.array(*map(F.lit, MOVES))).alias("m")
    moved = base.select("*", knob).select("*", move).select(*[F.greatest(F.lit(0.0), F.col(f"b{i}") + F.when(F.col("k") == i, F.col("m")).otherwise(0.0)).alias(f"w{i}") for i in range(1, 5)])
    every = base.toDF(*_W).union(moved).withColumn("t", F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")).filter("t > 0")
    grid = every.select(*[F.round(F.col(w) / F.col("t"), 4).alias(w) for w in _W]).distinct()
    grid = grid.filter(F.abs(F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4") - 1) <= 0.0003).filter(F.col("w4") <= MOST_LAST)
    return grid.withColumn("name", F.concat_ws("/", *[F.format_string("%.4f", w) for w in _W]))


@query("b9_u3_neighbours", f"with {_NEIGHBOURS} select name, w1, w2, w3, w4 from kept")
def _(s: SparkSession, d: str) -> DataFrame:
    return neighbours(s).select("name", *_W)


REFERENCE = (0.5, 0.2, 0.2, 0.1)
_KNOBS = "+".join(f"(abs(w{i}-{r})>0.005)::int" for i, r in enumerate(REFERENCE, 1))


def knob_distance(weights: list[str], reference: tuple[float, ...]) -> Column:
    """How many weights differ from those of a reference by more than 0.005."""
    return sum(((F.abs(F.col(w) - r) > 0.005).cast("int") for w, r in zip(weights, reference)), F.lit(0))


@query("r8_knob_distance", f"with {_NEIGHBOURS} select name, {_KNOBS} as distance from kept")
def _(s, d):
    return neighbours(s).select("name", knob_distance(_W, REFERENCE).alias("distance"))


# what each candidate does on train and on the test splits

_BLEND = "w1*s1+w2*s2+w3*s3+w4*s4"
_CAND = (
    f"with {PAPERS_SQL}, {TESTS_SQL}, {_NEIGHBOURS}, x as (select name, label, p1, {_pred_sql(_BLEND)} as p from papers cross join kept), "
    + "y as (select name, p1, " + _pred_sql(_BLEND) + " as p from tests cross join kept), "
    + "share as (select " + ",".join(f"count(*) filter(where label={k})/count(*)::double as q{k}" for k in range(1, 6)) + " from papers), "
    + f"train_side as (select name, {MET.format(p='p')}, count(*) filter(where p<>p1) as changed, count(*) filter(where abs(label-p)<abs(label-p1)) as improved, count(*) filter(where abs(label-p)>abs(label-p1)) as worsened, count(*) filter(where p>p1 and label<=2) as risky, count(*) filter(where p<p1 and label=5) as core from x group by 1), "
    + "test_side as (select name, count(*) filter(where p<>p1) as test_changed, round(" + "+".join(f"abs(count(*) filter(where p={k})/count(*)::double-(select q{k} from share))" for k in range(1, 6)) + ",6) as test_l1 from y group by 1), "
    + "base_qwk as (select " + MET.format(p="p1").split(", round(avg((label=")[0] + " from papers), "
    + "cand as (select name, train_side.qwk as qwk, mae, changed, improved, worsened, risky, core, test_changed, test_l1, round(train_side.qwk-base_qwk.qwk,6) as lift from train_side join test_side using(name) cross join base_qwk) "
)


def candidates(s: SparkSession, d: str) -> DataFrame:
    """One row per candidate: agreement on train, changes against the labels of s1, drift of the predicted shares on both test splits."""
    grid = F.broadcast(neighbours(s))
    pred = me.label_by_cuts(F.col("w1") * F.col("s1") + F.col("w2") * F.col("s2") + F.col("w3") * F.col("s3") + F.col("w4") * F.col("s4"), CUTS)
    train = papers(s, d).select("label", *NAMES, "p1")
    e, e1 = F.abs(F.col("label") - F.col("p")), F.abs(F.col("label") - F.col("p1"))
    on_train = train.crossJoin(grid).withColumn("p", pred).groupBy("name").agg(
        *me.scored("label", "p"), F.count_if(F.expr("p <> p1")).alias("changed"), F.count_if(e < e1).alias("improved"), F.count_if(e > e1).alias("worsened"),
        F.count_if(F.expr("p > p1 and label <= 2")).alias("risky"), F.count_if(F.expr("p < p1 and label = 5")).alias("core"),
    )
    share = train.agg(*[(F.count_if(F.col("label") == k) / F.count("*")).alias(f"q{k}") for k in range(1, 6)], r6(me.qwk("label", "p1")).alias("base"))
    on_test = held_out(s, d).select(*NAMES, "p1").crossJoin(grid).withColumn("p", pred).groupBy("name").agg(
        F.count_if(F.expr("p <> p1")).alias("test_changed"), *[(F.count_if(F.col("p") == k) / F.count("*")).alias(f"t{k}") for k in range(1, 6)]
    )
    drift = sum((F.abs(F.col(f"t{k}") - F.col(f"q{k}")) for k in range(1, 6)), F.lit(0.0))
    out = on_train.join(on_test, "name").crossJoin(F.broadcast(share))
    return out.select("name", "qwk", "mae", "changed", "improved", "worsened", "risky", "core", "test_changed", r6(drift).alias("test_l1"), r6(F.col("qwk") - F.col("base")).alias("lift"))


def safe(df: DataFrame, l1: float, changed: float, risky: float, core: float, least_lift: float = 0.0) -> DataFrame:
    """The candidates that gain, drift and change little, improve at least as many rows as they worsen, and keep under the caps of risky promotions and core demotions."""
    return df.filter((F.col("lift") > least_lift) & (F.col("test_l1") <= l1) & (F.col("test_changed") <= changed) & (F.col("test_changed") > 0) & (F.col("improved") >= F.col("worsened")) & (F.col("risky") <= risky) & (F.col("core") <= core))


def eligible(df: DataFrame, column: str, caps: list[float]) -> DataFrame:
    """The rows under the first of the caps that any row keeps; all rows if none does."""
    tier = F.lit(len(caps))
    for i, cap in reversed(list(enumerate(caps))):
        tier = F.when(F.col(column) <= cap, i).otherwise(tier)
    placed = df.withColumn("__tier", tier)
    best = placed.agg(F.min("__tier").alias("__best"))
    return placed.crossJoin(F.broadcast(best)).filter(F.col("__tier") <= F.col("__best")).drop("__tier", "__best")


def unique_picks(df: DataFrame, key: str, orders: dict[str, list[Column]]) -> DataFrame:
    """(pick, key): for each order its first row that no order before it has picked; ``df`` is a short list of candidates."""
    rest, out = df, None
    for pick, order in orders.items():
        one = rest.orderBy(*order).limit(1).select(F.lit(pick).alias("pick"), key)
        out = one if out is None else out.union(one)
        rest = rest.join(F.broadcast(one.select(key)), key, "left_anti")
    return out


_CAPS = {"l1": 1.2, "changed": 0.9, "risky": 0.2, "core": 0.2}


@query("g1_safe_candidates", _CAND + f"select cand.name, lift, test_l1, improved, worsened from cand cross join (select count(*) as n from papers) a cross join (select count(*) as m from tests) b where lift>-0.5 and test_l1<={_CAPS['l1']} and test_changed<={_CAPS['changed']}*m and test_changed>0 and improved>=worsened and risky<={_CAPS['risky']}*n and core<={_CAPS['core']}*n")
def _(s, d):
    """Caps are shares of the rows."""
    n, m = papers(s, d).agg(F.count("*").alias("n")), held_out(s, d).agg(F.count("*").alias("m"))
    c = candidates(s, d).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m))
    return safe(c, _CAPS["l1"], _CAPS["changed"] * F.col("m"), _CAPS["risky"] * F.col("n"), _CAPS["core"] * F.col("n"), -0.5).select("name", "lift", "test_l1", "improved", "worsened")


@query("g2_eligible", _CAND + ", t as (select *, case when test_l1<=0.05 then 0 when test_l1<=0.35 then 1 else 2 end as tier from cand) select name, qwk, test_l1 from t where tier<=(select min(tier) from t)")
def _(s, d):
    return eligible(candidates(s, d), "test_l1", [0.05, 0.35]).select("name", "qwk", "test_l1")


@query(
    "g3_unique_picks",
    _CAND + ", a as (select name from cand order by qwk desc, test_l1, name limit 1), b as (select name from cand where name not in (select name from a) order by test_l1, qwk desc, name limit 1), c as (select name from cand where name not in (select name from a) and name not in (select name from b) order by changed, qwk desc, name limit 1) select 'best' as pick, name from a union all select 'least_drift', name from b union all select 'closest', name from c",
)
def _(s, d):
    orders = {"best": [F.desc("qwk"), F.col("test_l1"), F.col("name")], "least_drift": [F.col("test_l1"), F.desc("qwk"), F.col("name")], "closest": [F.col("changed"), F.desc("qwk"), F.col("name")]}
    return unique_picks(candidates(s, d), "name", orders)


@query("g4_rank_score", _CAND + "select name, round(lift-0.0001*changed-0.05*test_l1,6) as rank_score from cand")
def _(s, d):
    return candidates(s, d).select("name", r6(F.col("lift") - 0.0001 * F.col("changed") - 0.05 * F.col("test_l1")).alias("rank_score"))


# rules that move single rows

_MARGIN = "least(" + ",".join(f"abs(s1-{c}::double)" for c in CUTS) + ")"
_CONTEXT = r"regexp_matches(lower(coalesce(title,'')),'case|survey|towards|report')"
_WORDS = "case|survey|towards|report"


def _proposals(df: DataFrame) -> DataFrame:
    """``df`` with margin, gap, context and priority of moving a row one step towards the label of s2."""
    margin = F.least(*[F.abs(F.col("s1") - c) for c in CUTS])
    df = df.withColumns({"margin": margin, "gap": F.abs(F.col("s1") - F.col("s2")), "context": F.lower(F.coalesce("title", F.lit(""))).rlike(_WORDS), "step": F.signum(F.col("p2") - F.col("p1")).cast("int")})
    return df.withColumn("priority", F.col("gap") - F.col("margin"))


_PROPOSED = f"prop as (select *, {_MARGIN} as margin, abs(s1-s2) as gap, {_CONTEXT} as context, sign(p2-p1)::int as step, abs(s1-s2)-{_MARGIN} as priority from papers)"


@query("g6_safe_demotion", P + f", {_PROPOSED}, k as (select id from prop where p1>=2 and step<0 and margin<=0.3 and gap>=0.1 and context order by priority desc, id limit 40) select prop.id, case when k.id is not null then p1-1 else p1 end as new_pred, k.id is not null as demoted from prop left join k using(id)")
def _(s, d):
    """One step down, in the contexts of the list only, for the rows of highest priority."""
    rows = _proposals(papers(s, d))
    can = rows.filter((F.col("p1") >= 2) & (F.col("step") < 0) & (F.col("margin") <= 0.3) & (F.col("gap") >= 0.1) & F.col("context"))
    picked = can.orderBy(F.desc("priority"), "id").limit(40).select("id", F.lit(True).alias("on"))
    on = F.coalesce("on", F.lit(False))
    return rows.join(F.broadcast(picked), "id", "left").select("id", F.when(on, F.col("p1") - 1).otherwise(F.col("p1")).alias("new_pred"), on.alias("demoted"))


RULES = [(i, m, g, n, p) for i, (m, g, n, p) in enumerate((m, g, n, p) for m in (0.05, 0.15) for g in (0.2, 0.4) for n in (10, 40) for p in (False, True))]


def sweep(rows: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """(rule, changed, improved, worsened, risky, lift of the mean error): what each rule would do to ``rows``; of each rule only its ``max_rows`` rows of highest priority change.

    Spark drops rows beyond the ``most`` that any rule changes before they are shuffled.
    """
    fits = rows.crossJoin(F.broadcast(rules)).filter((F.col("step") != 0) & (F.col("margin") <= F.col("margin_cap")) & (F.col("gap") >= F.col("conf_gap")) & (F.col("promote") | (F.col("step") < 0)))
    ranked = fits.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("priority"), "id"))).filter(F.col("r") <= most).filter(F.col("r") <= F.col("max_rows"))
    p = F.least(F.lit(5), F.greatest(F.lit(1), F.col("p1") + F.col("step")))
    e, e1 = F.abs(F.col("label") - p), F.abs(F.col("label") - F.col("p1"))
    per = ranked.groupBy("rule").agg(F.count("*").alias("changed"), F.count_if(e < e1).alias("improved"), F.count_if(e > e1).alias("worsened"), F.count_if((F.col("step") > 0) & (F.col("label") <= 2)).alias("risky"), F.sum(e - e1).alias("error"))
    return rules.select("rule").join(per, "rule", "left").na.fill(0)


@query(
    "g8_rule_sweep",
    P + f", {_PROPOSED}, rules(rule,margin_cap,conf_gap,max_rows,promote) as (values " + ",".join(f"({i},{m}::double,{g}::double,{n},{str(p).lower()})" for i, m, g, n, p in RULES)
    + "), f as (select rule, id, label, p1, step, max_rows, least(5,greatest(1,p1+step)) as p, row_number() over(partition by rule order by priority desc, id) as r from prop cross join rules where step<>0 and margin<=margin_cap and gap>=conf_gap and (promote or step<0)), k as (select rule, count(*) as changed, count(*) filter(where abs(label-p)<abs(label-p1)) as improved, count(*) filter(where abs(label-p)>abs(label-p1)) as worsened, count(*) filter(where step>0 and label<=2) as risky, sum(abs(label-p)-abs(label-p1)) as error from f where r<=max_rows group by 1) "
    "select rules.rule, coalesce(changed,0) as changed, coalesce(improved,0) as improved, coalesce(worsened,0) as worsened, coalesce(risky,0) as risky, coalesce(error,0)::bigint as error from rules left join k using(rule)",
)
def _(s, d):
    rules = s.createDataFrame(RULES, "rule int, margin_cap double, conf_gap double, max_rows int, promote boolean")
    rows = _proposals(papers(s, d)).select("id", "label", "p1", "step", "margin", "gap", "priority")
    return sweep(rows, rules, max(r[3] for r in RULES))


# blends

_Z = "(select anchor, id, label, list_transform(range(1,6), lambda k: -(score-k)*(score-k)) as c from long)"


@query(
    "b5_top_models",
    PL + f", q as (select anchor, {MET.format(p='pred').split(', round(avg((label=')[0]} from long group by 1), top as (select anchor from q order by qwk desc, anchor limit 2), z as (select id, list_transform(c, lambda x: (x-list_avg(c))/(case when list_stddev_pop(c)=0 then 1 else list_stddev_pop(c) end)) as z from {_Z} join top using(anchor)), m as (select id, " + ",".join(f"avg(z[{k}]) as z{k}" for k in range(1, 6)) + " from z group by 1) select id, " + ",".join(f"round(z{k},6) as z{k}" for k in range(1, 6)) + ", list_position([z1,z2,z3,z4,z5], greatest(z1,z2,z3,z4,z5))::int as best from m",
)
def _(s, d):
    """Mean of the class scores, brought to one scale per row, of the two models of highest kappa."""
    long = long_scores(papers(s, d))
    top = long.groupBy("anchor").agg(r6(me.qwk("label", "pred")).alias("qwk")).orderBy(F.desc("qwk"), "anchor").limit(2).select("anchor")
    c = F.array(*[-(F.col("score") - k) * (F.col("score") - k) for k in range(1, 6)])
    rows = long.join(F.broadcast(top), "anchor").select("id", c.alias("c"))
    mean = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / 5
    rows = rows.withColumn("m", mean).withColumn("sd", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / 5))
    z = rows.select("id", F.transform("c", lambda x: (x - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z"))
    m = z.groupBy("id").agg(*[F.avg(F.col("z")[k - 1]).alias(f"z{k}") for k in range(1, 6)])
    every = F.array(*[F.col(f"z{k}") for k in range(1, 6)])
    return m.select("id", *[r6(f"z{k}").alias(f"z{k}") for k in range(1, 6)], F.array_position(every, F.array_max(every)).cast("int").alias("best"))


@query(
    "b6_weighted_mean",
    PL + f", q as (select anchor, greatest(qwk,0.0) as w from (select anchor, {MET.format(p='pred').split(', round(avg((label=')[0]} from long group by 1)), t as (select sum(w) as t, count(*) as n from q) select id, round(avg(score),6) as mean, round(sum(score*case when t>0 then w/t else 1.0/n end),6) as weighted from long join q using(anchor) cross join t group by 1",
)
def _(s, d):
    """The plain mean of the scores, and the mean weighted by the kappa of each; equal weights where no kappa is positive."""
    long = long_scores(papers(s, d))
    w = long.groupBy("anchor").agg(F.greatest(r6(me.qwk("label", "pred")), F.lit(0.0)).alias("w"))
    t = w.agg(F.sum("w").alias("t"), F.count("*").alias("n"))
    share = F.broadcast(w.crossJoin(t).select("anchor", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1.0 / F.col("n")).alias("share")))
    return long.join(share, "anchor").groupBy("id").agg(r6(F.avg("score")).alias("mean"), r6(F.sum(F.col("score") * F.col("share"))).alias("weighted"))


_SUMS = {"n": "1", "x": "s1", "z": "s2", "y": "label", "xx": "s1*s1", "zz": "s2*s2", "xz": "s1*s2", "xy": "s1*label", "zy": "s2*label"}
_RIDGE = "w as (select fold, mx, mz, my, (c*p-b*q)/(a*c-b*b) as u, (a*q-b*p)/(a*c-b*b) as v from (select fold, x/n as mx, z/n as mz, y/n as my, xx-x*x/n+5.0::double as a, xz-x*z/n as b, zz-z*z/n+5.0::double as c, xy-x*y/n as p, zy-z*y/n as q from rest))"


@query(
    "b7_out_of_fold_stack",
    PF + ", per as (select fold, " + ",".join(f"sum(({e})::double) as {n}" for n, e in _SUMS.items()) + " from folds group by 1), rest as (select a.fold, " + ",".join(f"sum(b.{n}) as {n}" for n in _SUMS) + f" from per a join per b on a.fold<>b.fold group by 1), {_RIDGE} select id, round(least(greatest(my+u*(s1-mx)+v*(s2-mz),1.0),5.0),4) as stacked from folds join w using(fold)",
)
def _(s, d):
    """Ridge over two scores, each fold scored by the coefficients of the others: sums per fold, the own fold taken off, solved in columns."""
    b = with_folds(papers(s, d).select("id", "label", "s1", "s2"))
    per = b.groupBy("fold").agg(*[F.sum(F.expr(e).cast("double")).alias(n) for n, e in _SUMS.items()])
    total = per.agg(*[F.sum(n).alias(f"t_{n}") for n in _SUMS])
    k = per.crossJoin(total).select("fold", *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in _SUMS])
    k = k.selectExpr("fold", "x/n as mx", "z/n as mz", "y/n as my", "xx-x*x/n+5.0 as a", "xz-x*z/n as b", "zz-z*z/n+5.0 as c", "xy-x*y/n as p", "zy-z*y/n as q")
    w = k.selectExpr("fold", "mx", "mz", "my", "(c*p-b*q)/(a*c-b*b) as u", "(a*q-b*p)/(a*c-b*b) as v")
    score = F.col("my") + F.col("u") * (F.col("s1") - F.col("mx")) + F.col("v") * (F.col("s2") - F.col("mz"))
    return b.join(F.broadcast(w), "fold").select("id", F.round(clip(score), 4).alias("stacked"))


@query("b10_optional_anchors", "select id, count(n) as anchors, coalesce(sum(n),0)::bigint as records from (select id from train) left join (select id, count(*) as n from abstracts_merged_v3 where source_split='train' group by 1 union all select id, count(*) from s2_match_abstracts where source_split='train' group by 1) using(id) group by 1")
def _(s, d):
    """Sources that exist are taken in, the others left out: here two crawls and one that was never made."""
    out = table(s, d, "train", "id")
    schema = table(s, d, "abstracts_merged_v3", "source_split", "id").schema
    parts = [read_if_exists(s, f"{d}/{name}.parquet", schema).filter("source_split = 'train'").groupBy("id").agg(F.count("*").alias("n")) for name in ("abstracts_merged_v3", "s2_match_abstracts", "s2_second_crawl")]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.join(found, "id", "left").groupBy("id").agg(F.count("n").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


@query(
    "k2_histogram",
    P + "select least(floor((s1-1.0::double)/(4.0::double/400))::int,399) as bin, label, count(*) as n from papers group by 1,2",
)
def _(s, d):
    """The histogram on which cut points are sought."""
    return od.score_histogram(papers(s, d), "s1", "label")


@query(
    "a23_changes_by_split",
    f"with {TESTS_SQL} select source_split, p1, p2, count(*) as n, sum(abs(p2-p1))::bigint as moved, round(avg(s2-s1),6) as shift, count(*) filter(where p2>p1) as up, count(*) filter(where p2<p1) as down from tests where p1<>p2 group by 1,2,3",
)
def _(s, d):
    """Changed labels of the test splits, by split and direction."""
    x = held_out(s, d).filter("p1 <> p2")
    return x.groupBy("source_split", "p1", "p2").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("p2") - F.col("p1"))).cast("long").alias("moved"), r6(F.avg(F.col("s2") - F.col("s1"))).alias("shift"), F.count_if(F.expr("p2 > p1")).alias("up"), F.count_if(F.expr("p2 < p1")).alias("down"))


@query("g9_changed_rows", f"with {TESTS_SQL} select source_split, id, p1, p2 from tests where p1<>p2")
def _(s, d):
    return held_out(s, d).filter("p1 <> p2").select("source_split", "id", "p1", "p2")


@query("a23_largest_changes", f"with {TESTS_SQL} select source_split, id, round(s2-s1,6) as shift from (select *, row_number() over(partition by source_split order by abs(s2-s1) desc, id) as r from tests) where r<=10")
def _(s, d):
    x = held_out(s, d).withColumn("size", F.abs(F.col("s2") - F.col("s1")))
    return top_per_group(x, ["source_split"], [F.desc("size"), F.col("id")], 10).select("source_split", "id", r6(F.col("s2") - F.col("s1")).alias("shift"))
