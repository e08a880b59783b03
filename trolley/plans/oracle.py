"""DuckDB SQL for the oracle checks, built from named CTE fragments.

Each fragment mirrors one library step on the pre-registered parquet views
(orders, lineitem, part, customer, nation, documents, ...). Queries compose the fragments
they need into one ``WITH`` statement.
"""

from __future__ import annotations

from trolley.functions.hashing import sql_gaussian, sql_uniform, sql_uniform_int
from trolley.functions.text import sql_drop_stop_words, sql_tokenize

TOP_TOKENS = 30000  # fixed value: vocabulary size of the reference job
HISTORY_BEFORE = "1996-01-01"


def items_sql(where: str = "", many_makers: bool = False) -> str:
    """Basket-item rows; ``many_makers``: an item's suppliers are its makers, and every seventh basket has no name."""
    name = "concat_ws(' ', c.c_mktsegment, n.n_name, o.o_orderpriority)"
    if many_makers:
        name = f"CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE {name} END"
    return f"""
    SELECT o.o_orderkey AS pid,
           {name} AS name,
           lower({name}) AS pname,
           CAST(l.l_partkey AS VARCHAR) AS item,
           {"CAST(l.l_suppkey AS VARCHAR)" if many_makers else "p.p_brand"} AS maker, p.p_type AS grp, p.p_name AS item_name,
           p.p_brand AS maker_name, p.p_type AS grp_name
    FROM orders o
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    LEFT JOIN part p ON l.l_partkey = p.p_partkey
    {where}"""


def dict_sql(source: str, col: str, id_col: str) -> str:
    return f"""
    SELECT {col}, row_number() OVER (ORDER BY freq DESC, {col}) - 1 AS {id_col}, freq
    FROM (SELECT {col}, count(*) AS freq FROM {source} WHERE {col} IS NOT NULL GROUP BY {col})"""


def arr_text(expr: str) -> str:
    """Sorted distinct id list rendered as text."""
    return f"array_to_string(list_sort(list_distinct({expr})), ' ')"


class Sql:
    """Ordered CTE collection; ``need`` pulls a fragment and its dependencies in."""

    def __init__(self, items: str | None = None):
        self.items_body = items or items_sql()
        self.ctes: dict[str, str] = {}

    def add(self, name: str, body: str) -> "Sql":
        if name not in self.ctes:
            self.ctes[name] = body
        return self

    def render(self, final: str) -> str:
        if not self.ctes:
            return final
        parts = ",\n".join(f"{n} AS ({b}\n)" for n, b in self.ctes.items())
        return f"WITH {parts}\n{final}"

    # ---- baskets and dictionaries -------------------------------------------------
    def items(self):
        return self.add("items", self.items_body)

    def item_dict(self):
        self.items()
        self.add("item_dict", dict_sql("items", "item", "item_id"))
        return self.add("n_items", "SELECT count(*) AS n FROM item_dict")

    def encoded(self):
        self.item_dict()
        return self.add("encoded", """
    SELECT i.*, coalesce(d.item_id, (SELECT n FROM n_items)) AS item_id
    FROM items i LEFT JOIN item_dict d ON i.item = d.item""")

    def item_text(self):
        self.items()
        return self.add("item_text", """
    SELECT pid, item, concat_ws(' ', name, item_name, maker_name, grp_name) AS names FROM items""")

    def vocab(self):
        self.item_text()
        self.add("vocab_counts", f"""
    SELECT token, count(*) AS freq
    FROM (SELECT unnest({sql_tokenize('names')}) AS token FROM item_text)
    GROUP BY token""")
        self.add("vocab", f"""
    SELECT token, token_id, freq FROM (
      SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS token_id FROM vocab_counts)""")
        return self.add("n_tokens", "SELECT count(*) AS n FROM vocab")

    def name_feats(self, cte: str, source: str, key: str, name_col: str):
        """(key, feature_id) of name tokens, stop words removed, shifted past the item block."""
        self.item_dict()
        self.vocab()
        toks = sql_drop_stop_words(sql_tokenize(f"coalesce({name_col}, '')"))
        return self.add(cte, f"""
    SELECT DISTINCT t.{key}, v.token_id + (SELECT n FROM n_items) + 1 AS feature_id
    FROM (SELECT {key}, unnest({toks}) AS token FROM {source}) t
    JOIN vocab v ON t.token = v.token""")

    def basket_features(self):
        self.encoded()
        self.add("basket_names", "SELECT DISTINCT pid, name FROM items")
        self.name_feats("basket_name_feats", "basket_names", "pid", "name")
        return self.add("basket_features", """
    SELECT pid, feature_id, 1.0 AS value FROM (
      SELECT DISTINCT pid, item_id AS feature_id FROM encoded
      UNION ALL
      SELECT pid, feature_id FROM basket_name_feats)""")

    def num_features(self):
        self.item_dict()
        self.vocab()
        return self.add("num_features", "SELECT (SELECT n FROM n_items) + 1 + (SELECT n FROM n_tokens) AS n")

    # ---- negatives and labelled instances -----------------------------------------
    def tries(self, ratio: float = 1.0, seed_pid: int = 1, seed_item: int = 2):
        self.encoded()
        self.add("pos_stats", "SELECT count(*) AS n_rows, max(pid) AS max_pid FROM encoded")
        pid = sql_uniform_int("(SELECT max_pid FROM pos_stats) + 1", str(seed_pid), "try_id")
        item = sql_uniform_int("(SELECT n FROM n_items) + 1", str(seed_item), "try_id")
        return self.add("tries", f"""
    SELECT try_id, {pid} AS pid, {item} AS item_id
    FROM (SELECT range AS try_id FROM range(CAST(round({ratio} * (SELECT n_rows FROM pos_stats)) AS BIGINT)))""")

    def after_j1(self):
        self.tries()
        return self.add("after_j1", """
    SELECT t.* FROM tries t
    WHERE NOT EXISTS (SELECT 1 FROM encoded e WHERE e.item_id = t.item_id AND e.pid = t.pid)""")

    def after_j3(self):
        self.after_j1()
        self.add("after_j2", """
    SELECT a.*, b.pname FROM after_j1 a JOIN (SELECT DISTINCT pid, pname FROM encoded) b ON a.pid = b.pid""")
        return self.add("after_j3", """
    SELECT a.* FROM after_j2 a
    WHERE NOT EXISTS (SELECT 1 FROM encoded e WHERE e.item_id = a.item_id AND e.pname = a.pname)""")

    def after_j5(self):
        self.after_j3()
        self.add("after_j4", """
    SELECT a.*, m.maker FROM after_j3 a JOIN (SELECT DISTINCT item_id, maker FROM encoded) m
      ON a.item_id = m.item_id""")
        return self.add("after_j5", """
    SELECT a.* FROM after_j4 a
    WHERE NOT EXISTS (SELECT 1 FROM encoded e WHERE e.maker = a.maker AND e.pid = a.pid)""")

    def instances(self, test_share: float = 0.01, seed: int = 1):
        self.after_j5()
        self.add("neg_pairs", "SELECT DISTINCT pid, item_id FROM after_j5")
        self.add("pos_pairs", "SELECT DISTINCT pid, item_id FROM encoded")
        self.add("instances_raw", """
    SELECT pid * 2 + 1 AS instance_id, pid, 1 AS label, min(pname) AS pname FROM encoded GROUP BY pid
    UNION ALL
    SELECT pid * 2 AS instance_id, pid, 0 AS label, min(pname) AS pname FROM after_j5 GROUP BY pid""")
        u = sql_uniform(str(seed), "instance_id")
        self.add("instances", f"""
    SELECT *, CASE WHEN {u} < {test_share} THEN 'test' ELSE 'train' END AS split FROM instances_raw""")
        self.name_feats("instance_name_feats", "instances", "instance_id", "pname")
        return self.add("instance_features", """
    SELECT instance_id, feature_id, 1.0 AS value FROM (
      SELECT pid * 2 + 1 AS instance_id, item_id AS feature_id FROM pos_pairs
      UNION ALL
      SELECT pid * 2 AS instance_id, item_id AS feature_id FROM neg_pairs
      UNION ALL
      SELECT instance_id, feature_id FROM instance_name_feats)""")


def gaussian_sql(*parts: str) -> str:
    return sql_gaussian(*parts)


class FmSql:
    """FM steps in SQL over long-form parameters ``p_v(feature_id, f, v)``, ``p_w(feature_id, w)``."""

    def __init__(self, sql: Sql, k: int, std: float, seed: int, step: float, reg: tuple, task: int = 1,
                 mean: float = 0.0, local: bool = False, intercept: bool = True, linear: bool = True):
        """``local``: steps of local SGD with one instance per part (T1) instead of batch steps."""
        self.sql, self.k, self.std, self.seed, self.step_size, self.reg, self.task, self.mean, self.local = (
            sql, k, std, seed, step, reg, task, mean, local)
        self.intercept, self.linear = intercept, linear
        sql.instances()
        sql.num_features()
        sql.add("p0_v", f"""
    SELECT r.range AS feature_id, f.range AS f,
           {mean!r} + {std!r} * {sql_gaussian(str(seed), "'v'", 'r.range', 'f.range')} AS v
    FROM range((SELECT n FROM num_features)) r, range({k}) f""")
        sql.add("p0_w", "SELECT range AS feature_id, 0.0 AS w FROM range((SELECT n FROM num_features))")
        sql.add("p0_w0", "SELECT 0.0 AS w0")
        y = "CASE WHEN label > 0 THEN 1.0 ELSE -1.0 END" if task == 1 else "CAST(label AS DOUBLE)"
        sql.add("train_inst", f"""
    SELECT instance_id, {y} AS y FROM instances WHERE split = 'train'""")
        sql.add("lrange", "SELECT min(label) AS lo, max(label) AS hi FROM instances WHERE split = 'train'")
        sql.add("train_feats", """
    SELECT f.instance_id, f.feature_id, f.value FROM instance_features f
    WHERE f.instance_id IN (SELECT instance_id FROM train_inst)""")

    def margins(self, t: int, inst: str = "train_inst", feats: str = "train_feats", tag: str = "") -> str:
        """CTE ``st{t}{tag}(instance_id, y, z, m, loss)`` and ``mv{t}{tag}`` factor sums, model after t steps."""
        sql, sfx = self.sql, f"{t}{tag}"
        sql.add(f"mv{sfx}", f"""
    SELECT x.instance_id, p.f, sum(p.v * x.value) AS s, sum(p.v * p.v * x.value * x.value) AS q
    FROM {feats} x JOIN p{t}_v p ON x.feature_id = p.feature_id GROUP BY x.instance_id, p.f""")
        sql.add(f"ml{sfx}", f"""
    SELECT x.instance_id, sum(p.w * x.value) AS lin
    FROM {feats} x JOIN p{t}_w p ON x.feature_id = p.feature_id GROUP BY x.instance_id""")
        sql.add(f"mq{sfx}", f"""
    SELECT instance_id, sum(s * s) AS ss, sum(q) AS q FROM mv{sfx} GROUP BY instance_id""")
        y = "i.y" if "y" in self._inst_cols(inst) else "NULL"
        sql.add(f"st{sfx}", f"""
    SELECT i.instance_id, {y} AS y,
           {f"(SELECT w0 FROM p{t}_w0)" if self.intercept else "0.0"} + {"coalesce(l.lin, 0.0)" if self.linear else "0.0"} + 0.5 * coalesce(q.ss - q.q, 0.0) AS z
    FROM {inst} i LEFT JOIN ml{sfx} l ON i.instance_id = l.instance_id
    LEFT JOIN mq{sfx} q ON i.instance_id = q.instance_id""")
        return f"st{sfx}"

    @staticmethod
    def _inst_cols(inst: str) -> set:
        return {"y"} if inst == "train_inst" else set()

    def residuals(self, t: int) -> str:
        st = self.margins(t)
        if self.task == 1:
            m = "-y * (1.0 - 1.0 / (1.0 + exp(-y * z)))"
            loss = "ln(1 + exp(-y * z))"
        else:
            zc = "least(greatest(z, (SELECT lo FROM lrange)), (SELECT hi FROM lrange))"
            m = f"{zc} - y"
            loss = f"0.5 * ({zc} - y) * ({zc} - y)"
        self.sql.add(f"rs{t}", f"SELECT instance_id, y, z, {m} AS m, {loss} AS loss FROM {st}")
        return f"rs{t}"

    def gradient(self, t: int) -> str:
        rs = self.residuals(t)
        self.sql.add(f"g{t}", f"""
    SELECT x.feature_id, sum(r.m * x.value) AS c, sum(r.m * x.value * x.value) AS b, count(*) AS k
    FROM train_feats x JOIN {rs} r ON x.instance_id = r.instance_id GROUP BY x.feature_id""")
        self.sql.add(f"ga{t}", f"""
    SELECT x.feature_id, v.f, sum(r.m * v.s * x.value) AS a
    FROM train_feats x JOIN {rs} r ON x.instance_id = r.instance_id
    JOIN mv{t} v ON v.instance_id = x.instance_id GROUP BY x.feature_id, v.f""")
        return f"g{t}"

    def step(self, t: int) -> None:
        """Parameters after step t + 1 from those after step t (T2, full batch).

        A part of one instance moves from the common model by its own gradient and its own
        regularization term, so averaging over the n parts differs from the batch step only in
        that a feature is regularized k / n times, k being the instances that have it.
        """
        import math
        self.gradient(t)
        r0, r1, r2 = self.reg
        eta = self.step_size / math.sqrt(t + 1)
        n = f"(SELECT count(*) FROM rs{t})"
        scale = f"(1.0 / {n})"
        share = f"(g.k * {scale})" if self.local else "1.0"
        self.sql.add(f"p{t + 1}_w", f"""
    SELECT p.feature_id,
           CASE WHEN g.c IS NULL OR {not self.linear} THEN p.w ELSE p.w - {eta!r} * (g.c * {scale} + {r1!r} * {share} * p.w) END AS w
    FROM p{t}_w p LEFT JOIN g{t} g ON p.feature_id = g.feature_id""")
        self.sql.add(f"p{t + 1}_v", f"""
    SELECT p.feature_id, p.f,
           CASE WHEN g.c IS NULL THEN p.v
                ELSE p.v - {eta!r} * ((a.a - p.v * g.b) * {scale} + {r2!r} * {share} * p.v) END AS v
    FROM p{t}_v p LEFT JOIN g{t} g ON p.feature_id = g.feature_id
    LEFT JOIN ga{t} a ON a.feature_id = p.feature_id AND a.f = p.f""")
        self.sql.add(f"p{t + 1}_w0", f"""
    SELECT w0 - {eta if self.intercept else 0.0!r} * ((SELECT sum(m) FROM rs{t}) / {n} + {r0!r} * w0) AS w0 FROM p{t}_w0""")

    def params_after(self, t: int) -> str:
        for i in range(t):
            if f"p{i + 1}_v" not in self.sql.ctes:
                self.step(i)
        return f"""
SELECT v.feature_id, v.f, round(w.w, 6) AS w, round(v.v, 6) AS v, round((SELECT w0 FROM p{t}_w0), 6) AS w0
FROM p{t}_v v JOIN p{t}_w w ON v.feature_id = w.feature_id"""
