"""Named queries over the stand-in tables, each paired with DuckDB SQL where SQL can say it.

Every query reads whole tables from ``sf_dir`` and returns a DataFrame; the oracle SQL
computes the same rows on the same parquet files. Doubles that depend on summation order
are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.baskets import ITEM_COLUMNS, basket_items, explode_baskets, item_text
from trolley.operators.dictionary import encode_items, fit_dict
from trolley.functions.text import drop_stop_words, tokenize
from trolley.functions.text import sql_drop_stop_words, sql_tokenize
from trolley.operators.features import (basket_features, check_feature_range, fit_encoders, group_baskets, libsvm_lines,
                                       line_partitions, name_features, positive_baskets)
from trolley.operators.negatives import (attach_makers, attach_names, drop_seen_items, drop_seen_makers,
                                        drop_seen_names, group_negatives, sample_pairs)
from trolley.operators.split import split_instances
from trolley.operators.vocab import fit_vocab
from trolley.plans import context as ctx
from trolley.functions.hashing import sql_uniform
from trolley.operators.fm import (FMMeta, FMParams, fm_gradient, fm_init, fm_residuals, fm_score, fm_step,
                                 label_range)
from trolley.operators.fm_layout import instance_rows, training_layout
from trolley.operators.evaluate import curve_areas
from trolley.operators.recommend import basket_profile, recommend_lists, submission_lines
from trolley.plans.oracle import FmSql, HISTORY_BEFORE, TOP_TOKENS, Sql, arr_text, dict_sql, items_sql
from trolley.session import (ensure_checkpoint_dir, materialize, materialize_bucketed, materialize_together, release,
                             shuffle_partitions)
from trolley.sources.baskets import (read_baskets, read_split_baskets, stand_in_baskets, write_basket_document,
                                     write_baskets)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ids_text(col: str) -> F.Column:
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), " ")


# ---- baskets ------------------------------------------------------------------------

@register("basket_items", Sql().items().render(f"SELECT {', '.join(ITEM_COLUMNS)} FROM items"))
def q_basket_items(spark, sf_dir):
    return ctx.items(spark, sf_dir).select(*ITEM_COLUMNS)


@register("nested_round_trip", Sql().items().render(f"SELECT {', '.join(ITEM_COLUMNS)} FROM items"))
def q_nested_round_trip(spark, sf_dir):
    """Tables -> nested documents -> multi-line JSON files -> read -> explode -> items."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/basket-docs-{uuid.uuid4().hex}"
    write_baskets(stand_in_baskets(spark, sf_dir), path)
    docs = read_baskets(spark, f"{path}/slice=*/*.json")
    return basket_items(explode_baskets(docs)).select(*ITEM_COLUMNS)


@register("nested_one_file", Sql().items().render(f"SELECT {', '.join(ITEM_COLUMNS)} FROM items"))
def q_nested_one_file(spark, sf_dir):
    """All baskets as one document in one file, read in splits by several tasks."""
    path = _scratch(spark, "basket-document")
    baskets = materialize(stand_in_baskets(spark, sf_dir))  # read for the first pid and for the rows
    write_basket_document(baskets, path)
    release(baskets)
    small = {"spark.sql.files.maxPartitionBytes": _split_size(spark, path, 512 << 10), "spark.sql.files.openCostInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        docs = materialize(read_split_baskets(spark, path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return basket_items(explode_baskets(docs)).select(*ITEM_COLUMNS)


SPLITS = 64  # of large files that a query reads in small splits


def _split_size(spark, path: str, least: int) -> str:
    """Bytes of a split: ``least``, or as many as make ``SPLITS`` splits of what is in ``path``, and 128 MB at most."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    total = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return f"{max(least, min(total // SPLITS, 128 << 20))}b"


# ---- dictionaries ---------------------------------------------------------------------

for _col, _name in (("item", "item_dict"), ("maker", "maker_dict"), ("grp", "group_dict")):
    def _make(col):
        def q(spark, sf_dir):
            return fit_dict(ctx.items(spark, sf_dir), col, f"{col}_id")
        return q
    register(_name, Sql().items().render(f"SELECT * FROM ({dict_sql('items', _col, _col + '_id')})"))(_make(_col))


@register("encode_items", Sql().encoded().render("SELECT pid, item, item_id FROM encoded"))
def q_encode_items(spark, sf_dir):
    return ctx.encoded(spark, sf_dir).select("pid", "item", "item_id")


_unknown = Sql().items()
_unknown.add("history", items_sql(f"WHERE o.o_orderdate < TIMESTAMP '{HISTORY_BEFORE}'"))
_unknown.add("hist_dict", dict_sql("history", "item", "item_id"))
ORACLE_ENCODE_UNKNOWN = _unknown.render("""
SELECT i.pid, i.item, coalesce(d.item_id, (SELECT count(*) FROM hist_dict)) AS item_id
FROM items i LEFT JOIN hist_dict d ON i.item = d.item""")


@register("encode_unknown", ORACLE_ENCODE_UNKNOWN)
def q_encode_unknown(spark, sf_dir):
    """Dictionary fitted on history (orders before 1996), applied to every basket."""
    hist = ctx.history_items(spark, sf_dir)
    d = fit_dict(hist, "item", "item_id")
    n = d.count()
    return encode_items(ctx.items(spark, sf_dir).select("pid", "item"), d, n).select("pid", "item", "item_id")


@register("group_baskets", Sql().encoded().render(
    f"SELECT pid, name, {arr_text('list(item_id)')} AS item_ids FROM encoded GROUP BY pid, name"))
def q_group_baskets(spark, sf_dir):
    g = group_baskets(ctx.encoded(spark, sf_dir))
    return g.select("pid", "name", ids_text("item_ids").alias("item_ids"))


@register("positives", Sql().encoded().render(
    f"SELECT pid, 1 AS label, min(pname) AS pname, {arr_text('list(item_id)')} AS item_ids "
    "FROM encoded GROUP BY pid"))
def q_positives(spark, sf_dir):
    enc = ctx.encoded(spark, sf_dir)
    inst = positive_baskets(enc)
    pairs = enc.select("pid", "item_id").distinct().groupBy("pid").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return inst.join(pairs, "pid").select("pid", "label", "pname", ids_text("item_ids").alias("item_ids"))


@register("item_text", Sql().item_text().render("SELECT pid, item, names FROM item_text"))
def q_item_text(spark, sf_dir):
    return item_text(ctx.items(spark, sf_dir))


# ---- text ---------------------------------------------------------------------------------

_DOC_TOKENS = f"{sql_tokenize('coalesce(text, \'\')')}"


@register("tokens", f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens "
                    f"FROM (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents)")
def q_tokens(spark, sf_dir):
    """F3 on whole documents: lower-case whitespace tokens."""
    t = ctx.documents(spark, sf_dir).select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("stop_words", f"SELECT doc_id, len(t) AS n_kept, array_to_string(t, ' ') AS kept "
                        f"FROM (SELECT doc_id, {sql_drop_stop_words(_DOC_TOKENS)} AS t FROM documents)")
def q_stop_words(spark, sf_dir):
    """F4 on whole documents: tokens with the English stop words removed."""
    t = ctx.documents(spark, sf_dir).select(
        "doc_id", drop_stop_words(tokenize(F.coalesce("text", F.lit("")))).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_kept"), F.array_join("t", " ").alias("kept"))


@register("vocab", Sql().vocab().render("SELECT token, token_id, freq FROM vocab"))
def q_vocab(spark, sf_dir):
    """A6 on item text (name, item, maker and group names), cap 30,000."""
    return fit_vocab(item_text(ctx.items(spark, sf_dir)), "names")


_doc_vocab = Sql()
_doc_vocab.add("doc_counts", f"""
    SELECT token, count(*) AS freq
    FROM (SELECT unnest({sql_drop_stop_words(_DOC_TOKENS)}) AS token FROM documents) GROUP BY token""")


@register("doc_vocab", _doc_vocab.render(f"""
SELECT token, token_id, freq FROM (
  SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS token_id FROM doc_counts)
"""))
def q_doc_vocab(spark, sf_dir):
    """A6 with stop words removed, on whole multilingual documents: every token."""
    return fit_vocab(ctx.documents(spark, sf_dir), "text", stop_words=True)


@register("doc_vocab_top", _doc_vocab.render(f"""
SELECT token, token_id, freq FROM (
  SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS token_id FROM doc_counts)
WHERE token_id < {TOP_TOKENS}"""))
def q_doc_vocab_top(spark, sf_dir):
    """A6 with the reference job's size as an explicit top V (the cap binds here)."""
    return fit_vocab(ctx.documents(spark, sf_dir), "text", TOP_TOKENS, stop_words=True)


_nf = Sql()
_nf.items()
_nf.add("basket_names", "SELECT DISTINCT pid, name FROM items")
_nf.name_feats("basket_name_feats", "basket_names", "pid", "name")


@register("name_features", _nf.render("SELECT pid, feature_id FROM basket_name_feats"))
def q_name_features(spark, sf_dir):
    """Basket-name tokens (stop words removed) encoded past the item block."""
    enc = ctx.encoders(spark, sf_dir)
    names = ctx.items(spark, sf_dir).select("pid", "name").distinct()
    return name_features(names, "pid", "name", enc)


@register("basket_features", Sql().basket_features().render("SELECT pid, feature_id, value FROM basket_features"))
def q_basket_features(spark, sf_dir):
    """Step 3: item block + name-token block of every basket, long form."""
    rows = ctx.stored_items(spark, sf_dir)
    return basket_features(rows, fit_encoders(rows))


# ---- negatives ------------------------------------------------------------------------------

@register("random_pairs", Sql().tries().render("SELECT try_id, pid, item_id FROM tries"))
def q_random_pairs(spark, sf_dir):
    """S10 + U5: one try per positive basket-item row, md5-uniform basket and item."""
    e = ctx.encoded(spark, sf_dir)
    d, n = ctx.item_dict(spark, sf_dir)
    st = e.agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("m")).first()
    return sample_pairs(spark, st["n"], st["m"], n)


def _tries(spark, sf_dir, items=None):
    # the other columns of the items are not read: they neither move nor are written
    items = materialize((items or ctx.items(spark, sf_dir)).select("pid", "pname", "item", "maker"))
    d = materialize(fit_dict(items, "item", "item_id"))
    n = d.count()
    # the positives feed five joins: written once
    e = ctx.by_basket(encode_items(items, d, n).drop("item"))
    st = e.agg(F.count(F.lit(1)).alias("n"), F.max("pid").alias("m")).first()
    return e, sample_pairs(spark, st["n"], st["m"], n)


@register("drop_seen_items", Sql().after_j1().render("SELECT try_id, pid, item_id FROM after_j1"))
def q_drop_seen_items(spark, sf_dir):
    """Tries whose (item, basket) is not a positive."""
    e, cand = _tries(spark, sf_dir)
    return drop_seen_items(cand, e)


@register("drop_seen_names", Sql().after_j3().render("SELECT try_id, pid, item_id, pname FROM after_j3"))
def q_drop_seen_names(spark, sf_dir):
    """... and no basket of the same name holds the item."""
    e, cand = _tries(spark, sf_dir)
    return drop_seen_names(attach_names(drop_seen_items(cand, e), e), e)


@register("drop_seen_makers", Sql().after_j5().render(
    "SELECT try_id, pid, item_id, pname, maker FROM after_j5"))
def q_drop_seen_makers(spark, sf_dir):
    """... and the (try, maker) row's maker is new to the basket."""
    e, cand = _tries(spark, sf_dir)
    c = drop_seen_names(attach_names(drop_seen_items(cand, e), e), e)
    return drop_seen_makers(attach_makers(c, e), e).select("try_id", "pid", "item_id", "pname", "maker")


@register("negatives", Sql().after_j5().render(
    f"SELECT pid, 0 AS label, min(pname) AS pname, {arr_text('list(item_id)')} AS item_ids "
    "FROM after_j5 GROUP BY pid"))
def q_negatives(spark, sf_dir):
    """U7 + A1: one negative basket per pid that kept at least one try."""
    e, cand = _tries(spark, sf_dir)
    c = drop_seen_names(attach_names(drop_seen_items(cand, e), e), e)
    inst, pairs = group_negatives(drop_seen_makers(attach_makers(c, e), e))
    lists = pairs.groupBy("pid").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return inst.join(lists, "pid").select("pid", "label", "pname", ids_text("item_ids").alias("item_ids"))


@register("negatives_many_makers", Sql(items_sql(many_makers=True)).after_j5().render(
    f"SELECT pid, 0 AS label, min(pname) AS pname, {arr_text('list(item_id)')} AS item_ids, count(*) AS n_rows "
    "FROM after_j5 GROUP BY pid"))
def q_negatives_many_makers(spark, sf_dir):
    """J1-J5 + A1 where items have many makers and some baskets no name: row semantics of J4 and J5."""
    from trolley.sources.baskets import stand_in_items
    e, cand = _tries(spark, sf_dir, stand_in_items(spark, sf_dir, many_makers=True))
    c = drop_seen_names(attach_names(drop_seen_items(cand, e), e), e)
    # what is read of the rows: of each basket and item the least name, and how many there are
    rows = materialize_together(drop_seen_makers(attach_makers(c, e), e).groupBy("pid", "item_id").agg(F.min("pname").alias("pname"), F.count(F.lit(1)).alias("n")))
    inst, pairs = group_negatives(rows)
    lists = pairs.groupBy("pid").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    sizes = rows.groupBy("pid").agg(F.sum("n").alias("n_rows"))
    return inst.join(lists, "pid").join(sizes, "pid").select("pid", "label", "pname", ids_text("item_ids").alias("item_ids"), "n_rows")


# ---- labelled instances ---------------------------------------------------------------------

@register("labelled_instances", Sql().instances().render(f"""
SELECT i.instance_id, i.pid, i.label, i.pname, count(*) AS n_features,
       array_to_string(list_sort(list(f.feature_id)), ' ') AS feature_ids
FROM instances i JOIN instance_features f ON i.instance_id = f.instance_id
GROUP BY i.instance_id, i.pid, i.label, i.pname"""))
def q_labelled_instances(spark, sf_dir):
    """Step 2a: positives and sampled negatives with their item and name features."""
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    per = feats.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_features"),
                                           F.array_sort(F.collect_list("feature_id")).alias("f"))
    return inst.join(per, "instance_id").select("instance_id", "pid", "label", "pname", "n_features",
                                                ids_text("f").alias("feature_ids"))


@register("split_instances", Sql().instances().render("SELECT instance_id, label, split FROM instances"))
def q_split_instances(spark, sf_dir):
    """1 % test share by md5 uniform of the instance id (seed 1)."""
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    return inst.select("instance_id", "label", "split")


@register("libsvm_lines", Sql().instances().render("""
SELECT i.instance_id, i.split,
       CAST(CAST(i.label AS DOUBLE) AS VARCHAR) || ' ' ||
       string_agg(CAST(f.feature_id + 1 AS VARCHAR) || ':' || CAST(f.value AS VARCHAR), ' ' ORDER BY f.feature_id)
         AS line
FROM instances i JOIN instance_features f ON i.instance_id = f.instance_id
GROUP BY i.instance_id, i.split, i.label"""))
def q_libsvm_lines(spark, sf_dir):
    """libSVM text of every labelled instance, 1-based ascending indices."""
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    lines = libsvm_lines(inst, feats, partitions=line_partitions(feats))
    return inst.select("instance_id", "split").join(lines, "instance_id")


_fr = Sql().instances()
_fr.num_features()


@register("feature_range", _fr.render("""
SELECT count(*) AS n_rows, min(feature_id) AS min_feature_id, max(feature_id) AS max_feature_id,
       (SELECT n FROM num_features) AS num_features,
       min(feature_id) >= 0 AND max(feature_id) < (SELECT n FROM num_features) AS in_range
FROM instance_features"""))
def q_feature_range(spark, sf_dir):
    """F7 + A9: all instance feature ids fall inside N + 1 + V."""
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    return check_feature_range(feats, enc.num_features)


_po = Sql().basket_features()
_po.add("po_lines", f"""
    SELECT pid, CASE WHEN {sql_uniform('1', 'pid')} < 0.01 THEN 'test' ELSE 'train' END AS split,
           '1.0 ' || string_agg(CAST(feature_id + 1 AS VARCHAR) || ':' || CAST(value AS VARCHAR), ' '
                                 ORDER BY feature_id) AS line
    FROM basket_features GROUP BY pid""")


@register("positive_only_instances", _po.render("SELECT pid, split, line FROM po_lines"))
def q_positive_only_instances(spark, sf_dir):
    """Step 2b: every basket as a positive (label 1.0) libSVM line, split by basket."""
    rows = ctx.stored_items(spark, sf_dir)
    feats = materialize(basket_features(rows, fit_encoders(rows)))
    labels = feats.select("pid").distinct().withColumn("label", F.lit(1.0))
    lines = libsvm_lines(labels, feats, key="pid", partitions=line_partitions(feats))
    return split_instances(lines, 0.01, 1, split_by="pid").select("pid", "split", "line")


# ---- factorization machine --------------------------------------------------------------------
# Small, fixed configuration for oracle checks: k = 4 keeps the SQL readable; every
# regularization term is non-zero so each update path is exercised.
ORACLE_FM = FMParams(k=4, task=1, iterations=2, step=0.5, reg=(0.01, 0.001, 0.05), init_std=0.1, seed=7)


class _FmOracle(Sql):
    """Renders FM oracle SQL with rounded doubles normalised (-0.0 becomes 0.0, as in Spark)."""

    def render(self, final: str) -> str:
        return super().render(final.replace(", 6)", ", 6) + 0.0"))


def _fm_sql(local: bool = False) -> FmSql:
    hp = ORACLE_FM
    return FmSql(_FmOracle(), hp.k, hp.init_std, hp.seed, hp.step, hp.reg, hp.task, local=local)


def _r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _fm_context(spark, sf_dir, task: int = 1, rows=None):
    enc, inst, feats = ctx.labelled(spark, sf_dir, rows=rows)
    train = inst.where(F.col("split") == "train")
    meta = FMMeta(num_features=enc.num_features, k=ORACLE_FM.k, task=task)
    if task == 0:
        lo, hi = label_range(train)
        meta = FMMeta(num_features=enc.num_features, k=ORACLE_FM.k, task=0, min_label=lo, max_label=hi)
    params = fm_init(spark, enc.num_features, ORACLE_FM.k, ORACLE_FM.init_std, ORACLE_FM.seed)
    return enc, inst, feats, train, meta, params


def _long_params(params, meta):
    return params.select("feature_id", "w", F.posexplode("v").alias("f", "v")).select(
        "feature_id", "f", _r6("w").alias("w"), _r6("v").alias("v"), F.round(F.lit(meta.w0), 6).alias("w0"))


_fi = _fm_sql()


@register("fm_init", _fi.sql.render(_fi.params_after(0)))
def q_fm_init(spark, sf_dir):
    """M2: w = 0, v ~ Normal(0, 0.1) by Box-Muller on md5 uniforms (seed 7), n = N + 1 + V."""
    enc = ctx.encoders(spark, sf_dir)
    meta = FMMeta(num_features=enc.num_features, k=ORACLE_FM.k)
    return _long_params(fm_init(spark, enc.num_features, ORACLE_FM.k, ORACLE_FM.init_std, ORACLE_FM.seed), meta)


_fc = _fm_sql()
_fc_st = _fc.margins(0, inst="instances", feats="instance_features", tag="all")


@register("fm_score_class", _fc.sql.render(
    f"SELECT instance_id, round(z, 6) AS z, round(1.0 / (1.0 + exp(-z)), 6) AS prediction FROM {_fc_st}"))
def q_fm_score_class(spark, sf_dir):
    """M1 + F9: probability of every labelled instance under the initial model."""
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    s = fm_score(inst.select("instance_id"), feats, params, meta, others=False)
    return s.select("instance_id", _r6("z").alias("z"), _r6("prediction").alias("prediction"))


_fr2 = _fm_sql()
_fr2_st = _fr2.margins(0, inst="instances", feats="instance_features", tag="all")


@register("fm_score_reg", _fr2.sql.render(f"""
SELECT instance_id, round(z, 6) AS z,
       round(least(greatest(z, (SELECT lo FROM lrange)), (SELECT hi FROM lrange)), 6) AS prediction
FROM {_fr2_st}"""))
def q_fm_score_reg(spark, sf_dir):
    """M1 + F10: regression scores clipped to the training label range."""
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir, task=0)
    s = fm_score(inst.select("instance_id"), feats, params, meta, others=False)
    return s.select("instance_id", _r6("z").alias("z"), _r6("prediction").alias("prediction"))


_lr = _fm_sql()


@register("label_range", _lr.sql.render("SELECT lo AS min_label, hi AS max_label FROM lrange"))
def q_label_range(spark, sf_dir):
    """Label range of the training instances."""
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    return inst.where(F.col("split") == "train").agg(F.min("label").alias("min_label"),
                                                     F.max("label").alias("max_label"))


_rs = _fm_sql()
_rs_name = _rs.residuals(0)


@register("fm_residual", _rs.sql.render(
    f"SELECT instance_id, y, round(z, 6) AS z, round(m, 6) AS m, round(loss, 6) AS loss FROM {_rs_name}"))
def q_fm_residual(spark, sf_dir):
    """M3 + F12: logistic residual and loss of every training instance (labels as +1/-1)."""
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    r = fm_residuals(train, feats, params, meta)
    return r.select("instance_id", "y", _r6("z").alias("z"), _r6("m").alias("m"), _r6("loss").alias("loss"))


_gr = _fm_sql()
_gr.gradient(0)


@register("fm_gradient", _gr.sql.render("""
SELECT g.feature_id, a.f, round(g.c, 6) AS c, round(g.b, 6) AS b, round(a.a, 6) AS a
FROM g0 g JOIN ga0 a ON g.feature_id = a.feature_id"""))
def q_fm_gradient(spark, sf_dir):
    """M4: per active feature, sum m x, sum m x^2 and sum m s_f x over the training batch."""
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    # written once where the instances are: read by the scores, and by the gradient without another move
    tf = instance_rows(train, feats)
    g = fm_gradient(tf, fm_residuals(train, tf, params, meta), meta)
    return g.select("feature_id", _r6("c").alias("c"), _r6("b").alias("b"),
                    F.posexplode("a").alias("f", "a")).select("feature_id", "f", "c", "b", _r6("a").alias("a"))


def _steps(spark, sf_dir, n_steps):
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    tf = training_layout(train, feats)
    for t in range(1, n_steps + 1):
        params, meta, _ = fm_step(train, tf, params, meta, t, ORACLE_FM)
    return _long_params(params, meta)


for _t in (1, 2):
    _st = _fm_sql()
    register(f"fm_step_{_t}", _st.sql.render(_st.params_after(_t)))(
        (lambda n: lambda spark, sf_dir: _steps(spark, sf_dir, n))(_t))


def _train_query(name: str, task: int, intercept: bool, linear: bool, steps: int) -> None:
    hp = ORACLE_FM
    fs = FmSql(_FmOracle(), hp.k, hp.init_std, hp.seed, hp.step, hp.reg, task, intercept=intercept, linear=linear)

    def q(spark, sf_dir):
        from trolley.operators.fm import fm_train
        enc, inst, feats = ctx.labelled(spark, sf_dir)
        params, meta, _ = fm_train(inst.where(F.col("split") == "train"), feats, enc.num_features, task, steps, hp.step, (intercept, linear, hp.k),
                                   hp.reg, hp.init_std, hp.seed, method="batch")
        return _long_params(params, meta)

    q.__doc__ = f"T4-T7: {steps} steps of the train entry point, task {task}, intercept {intercept}, linear weights {linear}."
    register(name, fs.sql.render(fs.params_after(steps)))(q)


_train_query("fm_train_regression", 0, True, True, 2)
_train_query("fm_train_pairs_only", 1, False, False, 2)


# ---- recommendation and evaluation -------------------------------------------------------------

REC_K = 500   # items per basket, the reference job's report size


def _trained(spark, sf_dir, n_steps, rows=None, by_instance=False):
    """``by_instance``: the features are laid by instance, so training and a look-up of the hold-out do not move them again."""
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir, rows=rows)
    if by_instance:
        moved, feats = feats, materialize_bucketed(feats, shuffle_partitions(spark), "instance_id")
        release(moved)
    tf = training_layout(train, feats)
    for t in range(1, n_steps + 1):
        params, meta, _ = fm_step(train, tf, params, meta, t, ORACLE_FM)
    return enc, inst, feats, params, meta


def _rec_sql(k: int) -> tuple[FmSql, str]:
    fs = _fm_sql()
    fs.params_after(1)
    q = fs.sql
    q.basket_features()
    q.add("bk", "SELECT DISTINCT pid AS instance_id FROM basket_features")
    q.add("bf", "SELECT pid AS instance_id, feature_id, value FROM basket_features")
    st = fs.margins(1, inst="bk", feats="bf", tag="b")
    piv_s = ", ".join(f"max(CASE WHEN f = {f} THEN s END) AS s{f}" for f in range(ORACLE_FM.k))
    piv_v = ", ".join(f"max(CASE WHEN f = {f} THEN v END) AS v{f}" for f in range(ORACLE_FM.k))
    dot = " + ".join(f"c.v{f} * p.s{f}" for f in range(ORACLE_FM.k))
    q.add("prof", f"""
    SELECT t.instance_id AS pid, t.z, {piv_s}
    FROM {st} t JOIN mv1b m ON t.instance_id = m.instance_id GROUP BY t.instance_id, t.z""")
    q.add("cand", f"""
    SELECT w.feature_id AS item_id, w.w, {piv_v}
    FROM p1_w w JOIN p1_v v ON w.feature_id = v.feature_id
    WHERE w.feature_id < (SELECT n FROM n_items) GROUP BY w.feature_id, w.w""")
    q.add("scored", f"""
    SELECT p.pid, c.item_id, 1.0 / (1.0 + exp(-((p.z + c.w) + ({dot})))) AS score
    FROM prof p, cand c
    WHERE NOT EXISTS (SELECT 1 FROM encoded e WHERE e.pid = p.pid AND e.item_id = c.item_id)""")
    q.add("ranked", f"""
    SELECT * FROM (SELECT pid, item_id, score,
                          row_number() OVER (PARTITION BY pid ORDER BY score DESC, item_id) AS rank
                   FROM scored) WHERE rank <= {k}""")
    return fs, "ranked"


def _rec(spark, sf_dir, k):
    rows = ctx.stored_items(spark, sf_dir)
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 1, rows)
    bf = materialize(basket_features(rows, enc))
    return recommend_lists(bf, params, meta, enc.item_dict, enc.n_items, k=k)


_bp = _fm_sql()
_bp.params_after(1)
_bp.sql.basket_features()
_bp.sql.add("bk", "SELECT DISTINCT pid AS instance_id FROM basket_features")
_bp.sql.add("bf", "SELECT pid AS instance_id, feature_id, value FROM basket_features")
_bp_st = _bp.margins(1, inst="bk", feats="bf", tag="b")


@register("basket_profile", _bp.sql.render(f"""
SELECT t.instance_id AS pid, round(t.z, 6) AS z, m.f, round(m.s, 6) AS s
FROM {_bp_st} t JOIN mv1b m ON t.instance_id = m.instance_id"""))
def q_basket_profile(spark, sf_dir):
    """R2: raw score and factor sums of every basket under the one-step model."""
    rows = ctx.stored_items(spark, sf_dir)
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 1, rows)
    bf = basket_features(rows, enc)
    p = basket_profile(bf, params, meta)
    return p.select("pid", _r6("z").alias("z"), F.posexplode("s").alias("f", "s")).select(
        "pid", "z", "f", _r6("s").alias("s"))


_rq, _rq_name = _rec_sql(REC_K)


@register("recommend", _rq.sql.render(f"""
SELECT pid, count(*) AS n_items,
       string_agg(CAST(item_id AS VARCHAR) || ':' || CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ' ' ORDER BY rank) AS ranked
FROM {_rq_name} GROUP BY pid"""))
def q_recommend(spark, sf_dir):
    """R1 + U3 + P10: the top 500 of all new items per basket as ``id:score`` (millionths) in rank order."""
    entry = F.transform("top", lambda x: F.concat_ws(":", x["item_id"].cast("string"), F.round(x["score"] * 1000000).cast("bigint").cast("string")))
    return _rec(spark, sf_dir, REC_K).select("pid", F.size("top").cast("bigint").alias("n_items"), F.concat_ws(" ", entry).alias("ranked"))


_sq, _sq_name = _rec_sql(REC_K)
_SUBMISSION = _sq.sql.render(f"""
SELECT p.pid, CAST(p.pid AS VARCHAR) || coalesce(',' || string_agg(d.item, ',' ORDER BY r.rank), '') AS line
FROM prof p LEFT JOIN {_sq_name} r ON p.pid = r.pid LEFT JOIN item_dict d ON r.item_id = d.item_id GROUP BY p.pid""")


@register("submission_lines", _SUBMISSION)
def q_submission_lines(spark, sf_dir):
    """J7 + S6: ``pid,item1,...,item500`` per basket (item strings in rank order)."""
    return submission_lines(_rec(spark, sf_dir, REC_K))


@register("submission_file", _SUBMISSION)
def q_submission_file(spark, sf_dir):
    """S6 + P9: the recommendation job's text files, repartitioned, written and read back."""
    from trolley.plans.jobs import recommend_job
    rows = ctx.stored_items(spark, sf_dir)
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 1, rows)
    bf = materialize(basket_features(rows, enc))
    return recommend_job(bf, params, meta, enc, k=REC_K, out_path=_scratch(spark, "submission"), files=4)


def _auc_sql(threshold: float | None, where: str = "") -> str:
    fs = _fm_sql()
    fs.params_after(2)
    q = fs.sql
    q.add("test_inst", f"SELECT instance_id, label FROM instances WHERE split = 'test' {where}")
    q.add("test_feats", """
    SELECT f.instance_id, f.feature_id, f.value FROM instance_features f
    WHERE f.instance_id IN (SELECT instance_id FROM test_inst)""")
    st = fs.margins(2, inst="test_inst", feats="test_feats", tag="t")
    prob = "1.0 / (1.0 + exp(-t.z))"
    score = prob if threshold is None else f"CASE WHEN {prob} >= {threshold} THEN 1.0 ELSE 0.0 END"
    q.add("sc", f"SELECT i.label, {score} AS score FROM {st} t JOIN test_inst i ON t.instance_id = i.instance_id")
    q.add("cnt", """
    SELECT score, sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END) AS pos,
           sum(CASE WHEN label > 0.5 THEN 0 ELSE 1 END) AS neg FROM sc GROUP BY score""")
    q.add("cum", """
    SELECT score, pos, neg,
           sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
           sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM cnt""")
    q.add("pts", """
    SELECT pos, neg, tp - pos AS tp0, fp - neg AS fp0, tp / (tp + fp) AS prec,
           CASE WHEN tp - pos + fp - neg = 0 THEN tp / (tp + fp)
                ELSE (tp - pos) / (tp - pos + fp - neg) END AS prec0 FROM cum""")
    return q.render("""
SELECT round(sum(neg * (2.0 * tp0 + pos)) / nullif(2.0 * sum(pos) * sum(neg), 0), 6) AS area_under_roc,
       round(sum(pos * (prec + prec0) / 2.0) / nullif(sum(pos), 0), 6) AS area_under_pr,
       sum(pos) AS n_pos, sum(neg) AS n_neg
FROM pts""")


def _auc(spark, sf_dir, threshold, where="true"):
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 2, by_instance=True)
    test = inst.where(F.col("split") == "test").where(where)
    scored = fm_score(test.select("instance_id", "label"), feats, params, meta)
    a = curve_areas(scored, "prediction", "label", threshold)
    return a.select(_r6("area_under_roc").alias("area_under_roc"), _r6("area_under_pr").alias("area_under_pr"),
                    "n_pos", "n_neg")


@register("auc_threshold", _auc_sql(0.5))
def q_auc_threshold(spark, sf_dir):
    """F11 + E1 + E2: areas on 0/1 decisions at 0.5 for the hold-out, two-step model."""
    return _auc(spark, sf_dir, 0.5)


@register("auc_raw", _auc_sql(None))
def q_auc_raw(spark, sf_dir):
    """E1 + E2 on raw probabilities of the hold-out."""
    return _auc(spark, sf_dir, None)


@register("auc_positives_only", _auc_sql(0.5, "AND label > 0.5"))
def q_auc_positives_only(spark, sf_dir):
    """E1 + E2 on a hold-out of one class, as the positives-only job writes it: the ROC area is null."""
    return _auc(spark, sf_dir, 0.5, "label > 0.5")


# ---- round trips, trainers with rows-only checks, evaluation job -----------------------------------

def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_mr = _fm_sql()


@register("model_round_trip", _mr.sql.render(_mr.params_after(1)))
def q_model_round_trip(spark, sf_dir):
    """S8 + S9: the one-step model saved, reloaded and validated equals the oracle step."""
    from trolley.sources.model_io import load_fm, save_fm
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 1)
    path = _scratch(spark, "model")
    save_fm(params, meta, path)
    params2, meta2 = load_fm(spark, path)
    return _long_params(params2, meta2)


@register("dict_round_trip", Sql().items().render(f"SELECT * FROM ({dict_sql('items', 'item', 'item_id')})"))
def q_dict_round_trip(spark, sf_dir):
    """Item dictionary saved (overwrite) and loaded back."""
    from trolley.operators.dictionary import load_dict, save_dict
    path = _scratch(spark, "item-dict")
    save_dict(fit_dict(ctx.items(spark, sf_dir), "item", "item_id"), path)
    save_dict(load_dict(spark, path), path + "-copy")
    return load_dict(spark, path + "-copy")


@register("libsvm_round_trip", Sql().instances().render("""
SELECT CAST(i.label AS DOUBLE) AS label, count(*) AS n_features,
       array_to_string(list_sort(list(f.feature_id)), ' ') AS feature_ids
FROM instances i JOIN instance_features f ON i.instance_id = f.instance_id
GROUP BY i.instance_id, i.label"""))
def q_libsvm_round_trip(spark, sf_dir):
    """S3 + S4: libSVM lines written as text and parsed back into long features."""
    from trolley.sources.libsvm import read_libsvm, write_libsvm
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    path = _scratch(spark, "libsvm")
    write_libsvm(libsvm_lines(inst, feats, partitions=line_partitions(feats)), path)
    inst2, feats2 = read_libsvm(spark, path)
    per = feats2.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_features"),
                                            F.array_sort(F.collect_list("feature_id")).alias("f"))
    return inst2.join(per, "instance_id").select("label", "n_features", ids_text("f").alias("feature_ids"))


@register("libsvm_row_ids", Sql().instances().render("""
SELECT row_number() OVER (ORDER BY i.instance_id) - 1 AS line_no, i.instance_id AS written_id, CAST(i.label AS DOUBLE) AS label, count(*) AS n_features
FROM instances i JOIN instance_features f ON i.instance_id = f.instance_id GROUP BY i.instance_id, i.label"""))
def q_libsvm_row_ids(spark, sf_dir):
    """S3: ids of lines written in order of instance ids: places in the files, read in splits of 64 KB or, of larger files, in about ``SPLITS``."""
    from trolley.sources.libsvm import read_libsvm, write_libsvm
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    path = _scratch(spark, "libsvm")
    lines = libsvm_lines(inst, feats, partitions=line_partitions(feats)).select("instance_id", F.concat("line", F.lit(" "), F.col("instance_id") + enc.num_features + 1, F.lit(":1.0")).alias("line"))
    lines = materialize(lines)  # range partitioning reads its input twice
    write_libsvm(lines.repartitionByRange(max(3, shuffle_partitions(spark)), "instance_id").sortWithinPartitions("instance_id"), path)
    release(lines)
    small = {"spark.sql.files.maxPartitionBytes": _split_size(spark, path, 64 << 10), "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        inst2, feats2 = read_libsvm(spark, path)
        per = feats2.groupBy("instance_id").agg((F.count(F.lit(1)) - 1).alias("n_features"), (F.max("feature_id") - enc.num_features).alias("written_id"))
        out = materialize(inst2.join(per, "instance_id").select(F.col("instance_id").alias("line_no"), "written_id", "label", "n_features"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return out


@register("sparse_vectors", Sql().instances().render("""
SELECT i.instance_id, CAST(i.label AS DOUBLE) AS label, array_to_string(list_sort(list(f.feature_id)), ' ') AS indices, sum(f.value) AS total, count(*) AS n_active
FROM instances i JOIN instance_features f ON i.instance_id = f.instance_id GROUP BY i.instance_id, i.label"""))
def q_sparse_vectors(spark, sf_dir):
    """labelled instances as sparse vectors, written and read as such, and back in long form."""
    from trolley.functions.vectors import long_features, sparse_vectors
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    path = _scratch(spark, "vectors")
    sparse_vectors(inst.select("instance_id", F.col("label").cast("double").alias("label")), feats, enc.num_features).write.parquet(path)
    back = spark.read.parquet(path)
    per = long_features(back).groupBy("instance_id").agg(F.array_sort(F.collect_list("feature_id")).alias("f"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_active"))
    return back.select("instance_id", "label").join(per, "instance_id").select("instance_id", "label", ids_text("f").alias("indices"), "total", "n_active")


@register("evaluate_job", _auc_sql(0.5))
def q_evaluate_job(spark, sf_dir):
    """Hold-out libSVM file + saved two-step model -> ROC and PR areas at threshold 0.5."""
    from trolley.plans.jobs import evaluate_job
    from trolley.sources.libsvm import write_libsvm
    from trolley.sources.model_io import save_fm
    enc, inst, feats, params, meta = _trained(spark, sf_dir, 2, by_instance=True)
    test = inst.where(F.col("split") == "test")
    lines = libsvm_lines(test, feats.join(test.select("instance_id"), "instance_id", "left_semi"))
    test_path, model_path = _scratch(spark, "test"), _scratch(spark, "model")
    write_libsvm(lines, test_path)
    save_fm(params, meta, model_path)
    a = evaluate_job(spark, test_path, model_path, 0.5)
    return a.select(_r6("area_under_roc").alias("area_under_roc"), _r6("area_under_pr").alias("area_under_pr"),
                    "n_pos", "n_neg")


@register("job_round_trip", _auc_sql(0.5))
def q_job_round_trip(spark, sf_dir):
    """T8 + S1-S9 in a row: the training job saves its two-step model, the evaluation job loads it."""
    from trolley.plans.jobs import Labelled, evaluate_job, train_job
    from trolley.sources.libsvm import write_libsvm
    enc, inst, feats = ctx.labelled(spark, sf_dir)
    test = inst.where(F.col("split") == "test")
    test_path, model_path = _scratch(spark, "test"), _scratch(spark, "model")
    write_libsvm(libsvm_lines(test, feats.join(test.select("instance_id"), "instance_id", "left_semi")), test_path)
    train_job(Labelled(inst, feats), enc.num_features, ORACLE_FM, "batch", out_path=model_path)
    a = evaluate_job(spark, test_path, model_path, 0.5)
    return a.select(_r6("area_under_roc").alias("area_under_roc"), _r6("area_under_pr").alias("area_under_pr"),
                    "n_pos", "n_neg")


@register("fm_local_sgd")
def q_fm_local_sgd(spark, sf_dir):
    """T1 + A10 + T3: two passes of per-part SGD (8 parts) with averaged deltas."""
    from trolley.operators.fm import fm_fit_local_sgd
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    hp = FMParams(k=ORACLE_FM.k, task=1, iterations=2, step=0.1, reg=ORACLE_FM.reg,
                  init_std=ORACLE_FM.init_std, seed=ORACLE_FM.seed)
    p2, m2, hist = fm_fit_local_sgd(train, feats, enc.num_features, hp, n_parts=8)
    return _long_params(p2, m2)


_ls = _fm_sql(local=True)


@register("fm_local_sgd_single", _ls.sql.render(_ls.params_after(2)))
def q_fm_local_sgd_single(spark, sf_dir):
    """T1 + A10 + T3: two passes with one part per instance, where the averaged model has a closed form."""
    from trolley.operators.fm import fm_fit_local_sgd
    enc, inst, feats, train, meta, params = _fm_context(spark, sf_dir)
    p2, m2, _ = fm_fit_local_sgd(train, feats, enc.num_features, ORACLE_FM, n_parts=train.count(), part=F.col("instance_id"))
    return _long_params(p2, m2)


@register("features_round_trip", Sql().basket_features().render("SELECT pid, feature_id, value FROM basket_features"))
def q_features_round_trip(spark, sf_dir):
    """S5 + S2: challenge features written as Parquet and read back."""
    from trolley.plans.jobs import challenge_features_job, read_features
    rows = ctx.stored_items(spark, sf_dir)
    path = _scratch(spark, "features")
    challenge_features_job(rows, fit_encoders(rows), path, partitions=3)
    return read_features(spark, path)

FLAGSHIP = "recommend"
