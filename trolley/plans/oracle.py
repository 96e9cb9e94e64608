"""The SQL each registered query is compared with, over the same parquet tables."""

from __future__ import annotations

SPAN = 1 << 60

ORDERS = """
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS moment,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
         count(*) OVER (PARTITION BY o_custkey) AS total,
         lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_at
  FROM orders),
ord AS (
  SELECT order_id, user_id, CASE WHEN n = total AND total >= 2 THEN 'train' ELSE 'prior' END AS eval_set,
         CAST(n AS INT) AS order_number, CAST(dayofweek(moment) AS INT) AS order_dow,
         CAST(order_id % 24 AS INT) AS order_hour_of_day,
         CAST(date_diff('day', previous_at, moment) AS DOUBLE) AS days_since_prior_order
  FROM o)"""

LINES = ORDERS + """,
item AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL),
cart AS (
  SELECT order_id, product_id,
         CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, product_id) AS INT) AS add_to_cart_order
  FROM item),
ctx AS (
  SELECT cart.*, user_id, eval_set, order_number, order_dow, order_hour_of_day, days_since_prior_order,
         CASE WHEN order_number > min(order_number) OVER (PARTITION BY user_id, product_id)
              THEN 1 ELSE 0 END AS reordered
  FROM cart LEFT JOIN ord USING (order_id)),
pri AS (SELECT * FROM ctx WHERE eval_set = 'prior'),
trn AS (SELECT * FROM ctx WHERE eval_set = 'train')"""

HOT = LINES + """,
hot AS (
  SELECT * FROM (
    SELECT order_dow, order_hour_of_day, product_id, count(*) AS cnt,
           CAST(row_number() OVER (PARTITION BY order_dow, order_hour_of_day
                                   ORDER BY count(*) DESC, product_id) AS INT) AS rank
    FROM pri GROUP BY order_dow, order_hour_of_day, product_id) WHERE rank <= 20),
hot_lists AS (
  SELECT order_id, product_id, cnt, rank
  FROM (SELECT DISTINCT order_id, order_dow, order_hour_of_day FROM trn)
  JOIN hot USING (order_dow, order_hour_of_day))"""

SIM = LINES + """,
w AS (SELECT order_id, product_id, 1.0::DOUBLE + reordered AS weight FROM pri),
pair AS (
  SELECT a.product_id AS product_id1, b.product_id AS product_id2, sum(a.weight * b.weight) AS pair_weight
  FROM w a JOIN w b ON a.order_id = b.order_id AND a.product_id < b.product_id GROUP BY ALL),
norm AS (SELECT product_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY ALL),
one_way AS (
  SELECT product_id1, product_id2, round(pair_weight / (x.norm * y.norm), 9) AS sim
  FROM pair JOIN norm x ON x.product_id = product_id1 JOIN norm y ON y.product_id = product_id2),
two_way AS (
  SELECT product_id1 AS product_id, product_id2 AS sim_product_id, sim FROM one_way
  UNION ALL SELECT product_id2, product_id1, sim FROM one_way),
sims AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY round(sim, 9) DESC, sim_product_id)
                   AS INT) AS rank FROM two_way) WHERE rank <= 10)"""

TRIGGERS = """,
bought AS (
  SELECT user_id, product_id, max(order_number) AS last_order_number, count(*) AS times FROM pri GROUP BY ALL),
starts AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_order_number DESC, times DESC, product_id)
                   AS INT) AS rank FROM bought) WHERE rank <= 20)"""

ITEMCF = SIM + TRIGGERS + """,
asked AS (SELECT DISTINCT order_id, user_id FROM trn),
reached AS (
  SELECT DISTINCT asked.order_id, sims.sim_product_id AS product_id, sims.sim AS score
  FROM asked JOIN starts USING (user_id) JOIN sims USING (product_id))"""

BASKETS = LINES + """,
basket AS (SELECT order_id, list(product_id ORDER BY add_to_cart_order) AS items FROM ctx GROUP BY ALL)"""


def text(values: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({values}, '{sep}'), '')"


def draw(tag: str, *keys: str) -> str:
    joined = " || '|' || ".join(["'" + tag + "'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def keep(tag: str, fraction: float, key: str) -> str:
    return f"{draw(tag, key)} < {int(fraction * SPAN)}"


def outside(lines: str) -> str:
    """Baskets with the number of outside items before each of theirs."""
    return f""",
items AS (SELECT count(*) AS n, min(p_partkey) AS first FROM part),
own AS (
  SELECT order_id, list(product_id ORDER BY product_id) AS basket,
         list_transform(list(product_id - first ORDER BY product_id), lambda v, i: v - (i - 1)) AS starts,
         any_value(n) - count(*) AS free, any_value(first) AS first
  FROM {lines}, items GROUP BY order_id),
positive AS (SELECT order_id, starts, free, first, unnest(basket) AS product_id FROM own)"""


UNIFORM = LINES + outside("pri") + f""",
uniform AS (
  SELECT order_id, product_id,
         list_transform(
           list_transform(CASE WHEN free > 0 THEN range(1, 21) ELSE [] END,
                          lambda d: {draw("uni", "order_id", "product_id", "d")} % free),
           lambda p: p + len(list_filter(starts, lambda s: s <= p)) + first) AS negatives
  FROM positive),
cand AS (
  SELECT order_id, product_id, {text("list_append(negatives, product_id)")} AS candidates,
         {text("list_append(list_transform(negatives, lambda x: 0), 1)")} AS labels
  FROM uniform)"""

DISTINCT = LINES + outside("ctx") + f""",
steps AS (
  SELECT order_id, product_id, starts, free, first,
         list_transform(range(free - least(120, free), free),
                        lambda j: [j, {draw("neg", "order_id", "product_id", "j")} % (j + 1)]) AS steps
  FROM positive),
taken AS (
  SELECT order_id, product_id, starts, first,
         list_reduce(steps, lambda acc, s: list_append(acc, CASE WHEN list_contains(acc, s[2]) THEN s[1] ELSE s[2] END),
                     CAST([] AS BIGINT[])) AS positions
  FROM steps),
negative AS (
  SELECT order_id, product_id,
         list_transform(positions, lambda p: p + len(list_filter(starts, lambda s: s <= p)) + first) AS negatives
  FROM taken)"""

POPULAR = LINES + f""",
counted AS (
  SELECT product_id, CAST(round(pow(CAST(count(*) AS DOUBLE), 0.75) * 1e6) AS BIGINT) AS mass FROM pri GROUP BY ALL),
line_of_mass AS (
  SELECT product_id, mass, CAST(sum(mass) OVER (ORDER BY product_id) - mass AS BIGINT) AS low FROM counted),
total AS (SELECT CAST(sum(mass) AS BIGINT) AS total FROM counted),
cut AS (
  SELECT order_id, product_id, low, mass,
         CAST(coalesce(sum(mass) OVER (PARTITION BY order_id ORDER BY product_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS removed
  FROM pri JOIN line_of_mass USING (product_id)),
cuts AS (
  SELECT order_id, list(low - removed ORDER BY product_id) AS starts, list(mass ORDER BY product_id) AS masses,
         CAST(sum(mass) AS BIGINT) AS own
  FROM cut GROUP BY ALL),
drawn AS (
  SELECT order_id, product_id, d, starts, masses,
         {draw("pop", "order_id", "product_id", "d")} % (total - own) AS x
  FROM pri JOIN cuts USING (order_id), total, range(1, 21) t(d)),
moved AS (
  SELECT order_id, product_id, d,
         CAST(x + coalesce(list_sum(masses[1:len(list_filter(starts, lambda s: s <= x))]), 0) AS BIGINT) AS x FROM drawn),
found AS (
  SELECT order_id, moved.product_id, d, line_of_mass.product_id AS candidate
  FROM moved ASOF JOIN line_of_mass ON moved.x >= line_of_mass.low)"""

CHAIN_PRIOR = BASKETS + """,
chained AS (
  SELECT b.order_id, b.user_id, a.order_id AS last_order_id, b.order_dow, b.order_hour_of_day,
         b.days_since_prior_order
  FROM ord b JOIN ord a ON a.user_id = b.user_id AND a.order_number + 1 = b.order_number
  WHERE b.eval_set = 'prior' AND a.eval_set = 'prior' AND b.days_since_prior_order IS NOT NULL),
filled AS (
  SELECT chained.*, coalesce(l.items, []) AS last_basket, coalesce(t.items, []) AS basket
  FROM chained LEFT JOIN basket l ON l.order_id = last_order_id LEFT JOIN basket t ON t.order_id = chained.order_id)"""

CHAIN_TRAIN = BASKETS + """,
chained AS (
  SELECT b.order_id, b.user_id, a.order_id AS last_order_id, b.order_dow, b.order_hour_of_day,
         b.days_since_prior_order
  FROM ord b LEFT JOIN ord a ON a.user_id = b.user_id AND a.order_number + 1 = b.order_number
  WHERE b.eval_set = 'train'),
filled AS (
  SELECT chained.*, coalesce(l.items, []) AS last_basket, coalesce(t.items, []) AS basket
  FROM chained LEFT JOIN basket l ON l.order_id = last_order_id LEFT JOIN basket t ON t.order_id = chained.order_id)"""

DAYS = """,
gaps AS (
  SELECT avg(days_since_prior_order) AS mean_days, stddev_samp(days_since_prior_order) AS sd_days
  FROM ord WHERE eval_set = 'prior'),
contexts AS (
  SELECT filled.*, CAST((order_dow + 6) % 7 AS INT) AS dow_idx, order_hour_of_day AS hod_idx,
         round((days_since_prior_order - mean_days) / sd_days, 6) AS days_z,
         CAST(len(last_basket) AS INT) AS hist_len
  FROM filled, gaps)"""

FEATURES = BASKETS + """,
past AS (
  SELECT t.order_id, h.product_id, h.reordered,
         row_number() OVER (PARTITION BY t.order_id ORDER BY h.order_number DESC, h.add_to_cart_order DESC) AS nth,
         row_number() OVER (PARTITION BY t.order_id, h.reordered
                            ORDER BY h.order_number DESC, h.add_to_cart_order DESC) AS nth_of_kind
  FROM ord t JOIN ctx h ON h.user_id = t.user_id AND h.order_number < t.order_number),
hist AS (
  SELECT order_id, list(product_id ORDER BY nth) FILTER (nth <= 75) AS hist,
         list(product_id ORDER BY nth) FILTER (reordered = 1 AND nth_of_kind <= 20) AS hist_reordered
  FROM past GROUP BY ALL),
feat AS (
  SELECT ord.order_id, order_dow, order_hour_of_day AS order_hod, days_since_prior_order,
         """ + f"""{text("hist")} AS hist, {text("hist_reordered")} AS hist_reordered, {text("items")} AS basket
  FROM ord LEFT JOIN hist USING (order_id) LEFT JOIN basket USING (order_id) WHERE order_number > 1)"""

VECTORS = """
vec AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""

POOL = CHAIN_TRAIN + "," + VECTORS + """,
long AS (
  SELECT order_id, generate_subscripts(v, 1) AS dim, unnest(v) AS x
  FROM (SELECT order_id, unnest(last_basket) AS item_id FROM filled) JOIN vec USING (item_id)),
pool AS (
  SELECT order_id, list(m ORDER BY dim) AS q
  FROM (SELECT order_id, dim, avg(x) AS m FROM long GROUP BY ALL) GROUP BY ALL),
scored AS (
  SELECT order_id, item_id, list_inner_product(q, v) AS score FROM pool, vec),
ranked AS (
  SELECT order_id, item_id, score, exp(score - max(score) OVER own) / sum(exp(score)) OVER own
           * exp(max(score) OVER own) AS prob,
         CAST(row_number() OVER (PARTITION BY order_id ORDER BY round(score, 9) DESC, item_id) AS INT) AS rank
  FROM scored WINDOW own AS (PARTITION BY order_id))"""

CLICKS = """
log AS (
  SELECT event_id, CAST(event_type = 'click' AS INT) AS click, ts AS moment, value, user_id,
         CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(floor(value / 10) AS INT) AS value_bucket,
         CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour_of_day, CAST(day(ts) AS INT) AS day,
         CAST(year(ts) AS INT) AS year, CAST(month(ts) // 4 AS INT) AS month_b, CAST(day(ts) // 11 AS INT) AS day_b,
         CAST(hour(ts) // 2 AS INT) AS hour_b
  FROM events)"""

FIELDS = ["k", "user_id", "value_bucket", "weekday", "hour_of_day", "day"]
PROFILED = ["user_id", "k", "value_bucket", "weekday", "hour_of_day", "day", "year", "month_b", "day_b", "hour_b"]


def label_codes(condition: str) -> str:
    tables, joins, outs = [], [], []
    for c in FIELDS:
        tables.append(
            f"{c}_codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code "
            f"FROM (SELECT DISTINCT {c} AS v FROM log WHERE {condition} AND {c} IS NOT NULL))"
        )
        joins.append(f"LEFT JOIN {c}_codes ON {c}_codes.v = log.{c}")
        outs.append(f"coalesce({c}_codes.code, CAST((SELECT count(*) FROM {c}_codes) AS INT)) AS {c}")
    return f"WITH {CLICKS}, {', '.join(tables)} SELECT event_id, {', '.join(outs)} FROM log {' '.join(joins)}"


FIXED_TOWER = POOL + DAYS + """,
line_share AS (
  SELECT product_id AS item_id, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM pri)) AS log_q FROM pri GROUP BY ALL),
item_share AS (
  SELECT item_id, v, coalesce(log_q, (SELECT min(log_q) FROM line_share)) AS log_q FROM vec LEFT JOIN line_share USING (item_id)),
x AS (
  SELECT order_id, list_concat(q, list_transform(range(7), lambda i: CAST(i = dow_idx AS DOUBLE)),
           list_transform(range(24), lambda i: CAST(i = hod_idx AS DOUBLE)),
           [coalesce((days_since_prior_order - mean_days) / sd_days, 0)]) AS x
  FROM pool JOIN contexts USING (order_id), gaps),
wa AS (SELECT j, list(sin(i * 16 + j) / 4 ORDER BY i) AS w FROM range(96) a(i), range(16) b(j) GROUP BY j),
hidden AS (
  SELECT order_id, list(greatest(0::DOUBLE, list_inner_product(x, w) + cos(j) / 10) ORDER BY j) AS h
  FROM x, wa GROUP BY order_id),
wb AS (SELECT d, list(cos(j * 64 + d) / 4 ORDER BY j) AS w FROM range(16) a(j), range(64) b(d) GROUP BY d),
u AS (
  SELECT order_id, list(list_inner_product(h, w) + sin(d) / 10 ORDER BY d) AS u FROM hidden, wb GROUP BY order_id),
tower AS (
  SELECT order_id, item_id AS vec_id, list_inner_product(u, v) + 0.5::DOUBLE * log_q AS score FROM u, item_share),
best AS (
  SELECT order_id, vec_id, score, exp(score - max(score) OVER own) / sum(exp(score)) OVER own
           * exp(max(score) OVER own) AS prob,
         CAST(row_number() OVER (PARTITION BY order_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank
  FROM tower WINDOW own AS (PARTITION BY order_id))"""


def deepfm_scores(codes: str) -> str:
    """Forward pass with the registry's fixed weights: hidden layers of 16 and 8, 8 factors."""
    fields = " UNION ALL ".join(f"SELECT event_id, {i} AS f, {c} AS code FROM codes" for i, c in enumerate(FIELDS))

    def layer(name: str, before: str, values: str, rows: int, columns: int) -> str:
        return f"""
{name}_w AS (SELECT j, list(sin(i * {columns} + j) / 4 ORDER BY i) AS w
             FROM range({rows}) a(i), range({columns}) b(j) GROUP BY j),
{name} AS (SELECT event_id, list(greatest(0::DOUBLE, list_inner_product({values}, w) + cos(j) / 10) ORDER BY j) AS h
           FROM {before}, {name}_w GROUP BY event_id)"""

    return f"""WITH codes AS ({codes}), long AS ({fields}),
e AS (SELECT event_id, f, sin(100 * f + code) / 4 AS linear,
             list_transform(range(8), lambda d: sin(100 * f + code + 10 * d) / 4) AS e FROM long),
x AS (SELECT event_id, flatten(list(e ORDER BY f)) AS x, sum(linear) AS linear FROM e GROUP BY event_id),
one AS (SELECT event_id, unnest(e) AS v, generate_subscripts(e, 1) AS d FROM e),
pairs AS (SELECT event_id, sum(s * s - q) / 2 AS pairs
          FROM (SELECT event_id, d, sum(v) AS s, sum(v * v) AS q FROM one GROUP BY ALL) GROUP BY event_id),
{layer("h1", "x", "x", 48, 16)}, {layer("h2", "h1", "h", 16, 8)}
SELECT event_id, round(1 / (1 + exp(-(-0.1::DOUBLE + linear + pairs
         + list_inner_product(h, list_transform(range(8), lambda c: sin(c) / 2))))), 6) AS score
FROM x JOIN pairs USING (event_id) JOIN h2 USING (event_id)"""


def point(table: str, key: str) -> str:
    return (
        f"SELECT {key} AS id, CAST(({key} * 7919) % 18000 AS DOUBLE) / 100 - 90 AS lat, "
        f"CAST(({key} * 104729) % 36000 AS DOUBLE) / 100 - 180 AS lng FROM {table}"
    )


def cells(points: str, precision: int) -> str:
    xb, yb = (5 * precision + 1) // 2, 5 * precision // 2
    return f"""SELECT *, greatest(CAST(ceil((lng + 180) / 360 * {2**xb}) AS BIGINT) - 1, 0) AS x,
      greatest(CAST(ceil((lat + 90) / 180 * {2**yb}) AS BIGINT) - 1, 0) AS y FROM ({points})"""


def cell_text(x: str, y: str, precision: int) -> str:
    xb, yb = (5 * precision + 1) // 2, 5 * precision // 2
    letters = []
    for start in range(0, 5 * precision, 5):
        bits = []
        for place, bit in enumerate(range(start, start + 5)):
            name, width = (x, xb) if bit % 2 == 0 else (y, yb)
            bits.append(f"((({name}) >> {width - 1 - bit // 2}) & 1) * {16 >> place}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS INT) + 1, 1)")
    return " || ".join(letters)


BOTH = point("customer", "c_custkey") + " UNION ALL " + point("supplier", "s_suppkey")
STEPS = [("n", 0, 1), ("ne", 1, 1), ("e", 1, 0), ("se", 1, -1), ("s", 0, -1), ("sw", -1, -1), ("w", -1, 0), ("nw", -1, 1)]


def around(precision: int, own: bool) -> str:
    """The steps to neighbouring cells as a table, and the wrapped coordinates."""
    rows = [(i, d, e, n) for i, (d, e, n) in enumerate(STEPS)]
    if own:
        rows.append((8, "-", 0, 0))
    values = ", ".join(f"({i}, '{d}', {e}, {n})" for i, d, e, n in rows)
    return f"(VALUES {values}) step(place, direction, east, north)"


def wrapped(precision: int) -> tuple[str, str]:
    xb, yb = (5 * precision + 1) // 2, 5 * precision // 2
    return f"((x + east + {2**xb}) % {2**xb})", f"((y + north + {2**yb}) % {2**yb})"


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}

    for name, split in (("broad_table", "pri"), ("broad_table_train", "trn")):
        q[name] = f"""WITH {LINES}
SELECT order_id, user_id, product_id, add_to_cart_order, reordered, order_number, order_dow,
       order_hour_of_day AS order_hod, days_since_prior_order, p_brand AS aisle_id, p_type AS department_id
FROM {split} LEFT JOIN part ON p_partkey = product_id"""

    branch = """SELECT ord.order_id, ord.user_id, product_id, ord.order_number, add_to_cart_order, reordered
FROM ord LEFT JOIN {t} ON {t}.order_id = ord.order_id WHERE ord.eval_set = '{s}'"""
    q["all_orders"] = f"WITH {LINES} {branch.format(t='pri', s='prior')} UNION {branch.format(t='trn', s='train')}"

    q["main_orders_context"] = f"""WITH {LINES}
SELECT ord.order_id, ord.order_dow, ord.order_hour_of_day, ord.days_since_prior_order
FROM ord LEFT JOIN pri ON pri.order_id = ord.order_id WHERE ord.eval_set = 'prior'"""

    q["item_hot_time"] = f"""WITH {LINES}
SELECT * FROM (
  SELECT count(order_id) AS order_cnt, product_id, order_dow, order_hour_of_day AS order_hod,
         CAST(row_number() OVER (PARTITION BY product_id ORDER BY count(order_id) DESC, order_dow, order_hour_of_day)
              AS INT) AS ranking
  FROM pri GROUP BY product_id, order_dow, order_hour_of_day) WHERE ranking <= 1"""

    q["item_order_index"] = f"""WITH {LINES}
SELECT product_id, count(order_id) AS order_pv, count(DISTINCT user_id) AS order_uv,
       CAST(sum(reordered) AS BIGINT) AS reorder_pv, count(DISTINCT user_id) AS reorder_uv,
       count(DISTINCT user_id) FILTER (reordered = 1) AS reorder_uv_strict
FROM trn GROUP BY product_id"""

    q["item_avg_cart_order"] = f"""WITH {LINES}
SELECT product_id, round(avg(add_to_cart_order), 6) AS avg_cart_order FROM pri GROUP BY product_id"""

    q["popularity_probs"] = f"""WITH {LINES},
c AS (SELECT product_id, pow(CAST(count(*) AS DOUBLE), 0.75) AS mass FROM pri GROUP BY product_id)
SELECT p_partkey AS product_id, round(coalesce(mass / (SELECT sum(mass) FROM c), 0.0), 6) AS prob
FROM part LEFT JOIN c ON c.product_id = p_partkey"""

    q["days_stats"] = f"""WITH {ORDERS}
SELECT round(avg(days_since_prior_order), 6) AS mean_days,
       round(stddev_samp(days_since_prior_order), 6) AS sd_days FROM ord"""

    q["basket_stats"] = f"""WITH {LINES}, b AS (SELECT order_id, CAST(count(*) AS INT) AS n FROM pri GROUP BY order_id)
SELECT max(n) AS max_len, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS DOUBLE) AS p50_len,
       bool_and(n > 0) AS all_nonempty FROM b"""

    q["hot_by_slot"] = f"WITH {HOT} SELECT order_dow, order_hour_of_day, product_id, cnt, rank FROM hot"
    q["hot_recall"] = f"WITH {HOT} SELECT * FROM hot_lists"
    q["hot_recall_metric"] = f"""WITH {HOT}
SELECT count(h.product_id) AS tp, count(*) AS p,
       round(CAST(count(h.product_id) AS DOUBLE) / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS recall
FROM trn LEFT JOIN hot h USING (order_dow, order_hour_of_day, product_id)
WHERE (order_dow, order_hour_of_day) IN (SELECT (order_dow, order_hour_of_day) FROM hot)"""

    q["item_pairs"] = f"WITH {SIM} SELECT product_id1, product_id2, round(pair_weight, 6) AS pair_weight FROM pair"
    q["itemcf_sim"] = f"WITH {SIM} SELECT product_id, sim_product_id, sim, rank FROM sims"
    q["itemcf_sim_pruned"] = q["itemcf_sim"]
    q["user_triggers"] = f"""WITH {LINES}{TRIGGERS}
SELECT user_id, product_id, last_order_number, times, rank FROM starts"""
    q["user_triggers_by_times"] = f"""WITH {LINES}{TRIGGERS}
SELECT user_id, product_id, last_order_number, times, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY times DESC, last_order_number DESC, product_id)
                 AS INT) AS rank FROM bought) WHERE rank <= 20"""
    q["itemcf_recall"] = f"WITH {ITEMCF} SELECT order_id, product_id, score FROM reached"
    q["itemcf_recall_merged"] = f"""WITH {ITEMCF},
merged AS (SELECT order_id, product_id, sum(score) AS score FROM reached GROUP BY ALL)
SELECT order_id, product_id, round(score, 9) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY order_id ORDER BY round(score, 9) DESC, product_id) AS INT) AS rank
  FROM merged) WHERE rank <= 20"""
    q["itemcf_metric"] = f"""WITH {ITEMCF},
covered AS (SELECT DISTINCT order_id FROM asked JOIN starts USING (user_id)),
listed AS (SELECT DISTINCT order_id, product_id FROM reached),
t AS (SELECT order_id, count(*) AS p, count(listed.product_id) AS tp
      FROM trn LEFT JOIN listed USING (order_id, product_id) GROUP BY order_id),
l AS (SELECT order_id, count(*) AS recalled FROM listed GROUP BY order_id)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS p,
       CAST(coalesce(sum(recalled), 0) AS BIGINT) AS recalled, count(*) AS orders,
       round(CAST(sum(tp) AS DOUBLE) / CAST(sum(p) AS DOUBLE), 6) AS recall
FROM t JOIN covered USING (order_id) LEFT JOIN l USING (order_id)"""

    q["basket_sequences"] = f"""WITH {LINES}
SELECT order_id, string_agg(product_id, ' ' ORDER BY add_to_cart_order) AS seq FROM pri GROUP BY order_id"""
    q["basket_sequences_shuffled"] = f"""WITH {LINES}
SELECT order_id, CAST(copy AS INT) AS copy, string_agg(product_id, ' ' ORDER BY
         CASE WHEN copy = 0 THEN add_to_cart_order ELSE {draw("shuf", "copy", "order_id", "product_id")} END,
         product_id) AS seq
FROM pri, range(0, 3) t(copy) GROUP BY order_id, copy"""

    q["vector_neighbors"] = f"""WITH {VECTORS}
SELECT vec_id, neighbor_id, round(sim, 6) AS sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, neighbor_id) AS INT) AS rank FROM (
    SELECT a.item_id AS vec_id, b.item_id AS neighbor_id, list_cosine_similarity(a.v, b.v) AS sim
    FROM vec a JOIN vec b ON a.item_id <> b.item_id)) WHERE rank <= 10"""
    q["vector_neighbors_ivf"] = q["vector_neighbors"]
    q["pooled_vectors"] = f"""WITH {VECTORS}
SELECT label, CAST(dim - 1 AS INT) AS dim, round(avg(x), 6) AS mean_value
FROM (SELECT label, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM vec) GROUP BY label, dim"""
    q["pooled_recall"] = f"""WITH {POOL}
SELECT order_id, item_id AS vec_id, round(prob, 6) AS prob, rank FROM ranked WHERE rank <= 10"""
    q["pooled_recall_ivf"] = f"""WITH {POOL}
SELECT order_id, item_id AS vec_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"""
    q["pooled_recall_metric"] = f"""WITH {POOL},
best AS (SELECT order_id, item_id AS product_id FROM ranked WHERE rank <= 10),
t AS (SELECT order_id, count(*) AS p, count(best.product_id) AS tp
      FROM trn LEFT JOIN best USING (order_id, product_id) GROUP BY order_id),
l AS (SELECT order_id, count(*) AS recalled FROM best GROUP BY order_id)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS p, CAST(sum(recalled) AS BIGINT) AS recalled,
       count(*) AS orders, round(CAST(sum(tp) AS DOUBLE) / CAST(sum(p) AS DOUBLE), 6) AS recall
FROM t JOIN l USING (order_id)"""

    q["order_features"] = f"WITH {FEATURES} SELECT * FROM feat"
    q["order_negatives"] = f"WITH {DISTINCT} SELECT order_id, product_id, {text('negatives')} AS negatives FROM negative"
    q["order_lists_text"] = f"""WITH {FEATURES}{DISTINCT[len(LINES):]}
SELECT concat_ws(',', order_id, order_dow, order_hod, coalesce(CAST(days_since_prior_order AS VARCHAR), ''), hist,
                 hist_reordered, basket, {text("list_prepend(product_id, negatives)")}) AS line
FROM feat JOIN negative USING (order_id)"""
    q["uniform_negatives"] = f"WITH {UNIFORM} SELECT order_id, product_id, candidates, labels FROM cand"
    q["popularity_negatives"] = f"""WITH {POPULAR}
SELECT order_id, product_id, string_agg(candidate, ' ' ORDER BY d) || ' ' || product_id AS candidates,
       repeat('0 ', 20) || '1' AS labels
FROM found GROUP BY order_id, product_id"""

    chained = f"SELECT order_id, user_id, last_order_id, {text('last_basket')} AS last_basket, {text('basket')} AS basket"
    q["prev_basket"] = f"WITH {CHAIN_PRIOR} {chained} FROM filled"
    q["prev_basket_eval"] = f"WITH {CHAIN_TRAIN} {chained} FROM filled"
    padded = "list_transform(range(1, width + 1), lambda i: CASE WHEN i <= hist_len THEN last_basket[i] + 1 ELSE 0 END)"
    q["next_basket_train"] = f"""WITH {CHAIN_PRIOR}{DAYS}{UNIFORM[len(LINES):]},
widths AS (SELECT greatest(max(hist_len), 145) AS width FROM contexts)
SELECT order_id, dow_idx, hod_idx, days_z, hist_len, {text(padded)} AS hist_padded, product_id, candidates, labels
FROM contexts JOIN cand USING (order_id), widths"""
    q["prepared_train"] = q["next_basket_train"]
    q["next_basket_eval"] = f"""WITH {CHAIN_TRAIN}{DAYS}
SELECT order_id, dow_idx, hod_idx, days_z, hist_len, unnest(basket) AS product_id FROM contexts"""
    q["retriever_fixed"] = f"""WITH {FIXED_TOWER}
SELECT order_id, vec_id, round(score, 6) AS score, round(prob, 6) AS prob, rank FROM best WHERE rank <= 10"""
    q["retriever_top_text"] = f"""WITH {FIXED_TOWER}
SELECT order_id, vec_id AS product_id, round(round(score, 6), 3) AS score FROM best WHERE rank <= 10"""
    q["eval_head"] = q["next_basket_eval"] + "\nORDER BY order_id, product_id LIMIT 1000"
    flags = [f"CAST((order_dow + 6) % 7 = {i} AS INT) AS dow_{i}" for i in range(7)]
    flags += [f"CAST(order_hour_of_day = {i} AS INT) AS hod_{i}" for i in range(24)]
    q["slot_one_hot"] = f"WITH {ORDERS} SELECT order_id, {', '.join(flags)} FROM ord"

    q["ctr_time_features"] = f"""WITH {CLICKS}
SELECT event_id, year, month_b, day_b, hour_b, day, hour_of_day AS hour, weekday FROM log"""
    profile = " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM log" for c in PROFILED)
    q["ctr_column_profile"] = f"""WITH {CLICKS}, p AS ({profile})
SELECT name AS "column", n AS n_distinct, CAST(n > 1 AND n < 20 AS INT) AS keep_small,
       CAST(n < 10000 AS INT) AS keep_medium, CASE WHEN n > 100 THEN 'high' ELSE 'low' END AS size_class FROM p"""
    q["ctr_label_encoded"] = label_codes("moment < TIMESTAMP '2024-01-25'")
    def logit(step: int) -> str:
        return " + ".join(f"sin((100 * {i} + {c}) * {step}) / 4" for i, c in enumerate(FIELDS))

    q["ctr_lr_fixed"] = f"""WITH codes AS ({q["ctr_label_encoded"]})
SELECT event_id, round(1 / (1 + exp(-(-0.5::DOUBLE + {logit(1)}))), 6) AS score FROM codes"""
    models = " UNION ALL ".join(
        f"SELECT CAST({m} AS INT) AS model, click, round(1 / (1 + exp(-(-0.5::DOUBLE + {logit(m)}))), 9) AS score FROM marked"
        for m in (1, 2, 3)
    )
    q["ctr_choice_fixed"] = f"""WITH codes AS ({q["ctr_label_encoded"]}), {CLICKS},
marked AS (
  SELECT codes.*, click FROM codes JOIN (SELECT event_id, click, moment FROM log) USING (event_id)
  WHERE moment < TIMESTAMP '2024-01-25' AND {keep("rows", 0.7, "event_id")}
    AND (click = 1 OR {keep("negatives", 0.2, "event_id")}) AND {keep("valid", 0.15, "event_id")}),
scored AS ({models}),
r AS (SELECT model, click, rank() OVER (PARTITION BY model ORDER BY score)
        + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS r FROM scored),
s AS (SELECT model, CAST(sum(click) AS DOUBLE) AS p, CAST(count(*) - sum(click) AS DOUBLE) AS n,
             sum(CASE WHEN click = 1 THEN r END) AS ranks FROM r GROUP BY model),
a AS (SELECT model, round((ranks - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auc FROM s)
SELECT model, auc, CAST(model = (SELECT model FROM a ORDER BY auc DESC, model LIMIT 1) AS INT) AS chosen FROM a"""
    q["ctr_deepfm_fixed"] = deepfm_scores(q["ctr_label_encoded"])
    q["ctr_label_encoded_all"] = label_codes("true")
    q["ctr_first_seen_encoded"] = f"""WITH {CLICKS},
c AS (SELECT user_id, row_number() OVER (ORDER BY min(moment), user_id) - 1 AS code FROM log GROUP BY user_id)
SELECT event_id, code FROM log JOIN c USING (user_id)"""
    sizes = " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS size FROM log" for c in FIELDS[:3])
    q["ctr_vocabulary"] = f"""WITH {CLICKS}, s AS ({sizes}), m AS (SELECT max(size) AS largest FROM s)
SELECT field, size, largest FROM s, m
UNION ALL SELECT unnest(['day', 'hour_of_day', 'weekday']), unnest([31::BIGINT, 24, 7]), largest FROM m"""
    q["ctr_incremental_encoded"] = q["ctr_first_seen_encoded"]
    q["ctr_sketched_profile"] = f"""WITH {CLICKS}, p AS ({profile})
SELECT name AS "column", n AS n_distinct, CAST(1 AS INT) AS within_bound FROM p"""
    small = {"weekday": 7, "day_b": 3, "hour_b": 12}  # the columns of 2 to 19 values
    days = ", ".join(f"CAST({c} = {i} AS INT) AS {c}_{i}" for c, n in small.items() for i in range(n))
    q["ctr_dummies"] = f"WITH {CLICKS} SELECT event_id, click, {days} FROM log"
    q["ctr_small_sample"] = f"WITH {CLICKS} SELECT event_id, click, {days} FROM log WHERE {keep('small', 0.05, 'event_id')}"
    q["ctr_sampled"] = f"""WITH {CLICKS}
SELECT event_id, click, CASE WHEN {keep("valid", 0.15, "event_id")} THEN 'valid' ELSE 'train' END AS part FROM log
WHERE {keep("rows", 0.7, "event_id")} AND (click = 1 OR {keep("negatives", 0.2, "event_id")})"""
    q["auc_histogram"] = f"""WITH {CLICKS},
span AS (SELECT min(value) AS low, max(value) AS high FROM log),
r AS (SELECT click, CAST((value - low) / (high - low) * 256 AS DOUBLE) AS place FROM log, span),
b AS (SELECT *, least(floor(place), 255) AS bin FROM r),
n AS (SELECT bin, count(*) * 256 > (SELECT count(*) FROM b) AS crowded FROM b GROUP BY bin),
c AS (SELECT bin, CASE WHEN crowded THEN least(floor((place - bin) * 256), 255) ELSE 0 END AS inside, click
      FROM b JOIN n USING (bin)),
t AS (SELECT bin, inside, CAST(sum(click) AS DOUBLE) AS p, CAST(sum(1 - click) AS DOUBLE) AS q FROM c GROUP BY ALL),
e AS (SELECT *, coalesce(sum(q) OVER (ORDER BY bin, inside ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM t)
SELECT round(sum(p * below + p * q / 2) / (sum(p) * sum(q)), 6) AS auc,
       round(sum(p * q / 2) / (sum(p) * sum(q)), 6) AS error FROM e"""
    q["auc_exact"] = f"""WITH {CLICKS},
r AS (SELECT click, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM log),
s AS (SELECT CAST(sum(click) AS DOUBLE) AS p, CAST(count(*) - sum(click) AS DOUBLE) AS n,
             sum(CASE WHEN click = 1 THEN r END) AS ranks FROM r)
SELECT round((ranks - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auc FROM s"""

    score = "CAST(CAST(cnt AS DOUBLE) AS VARCHAR)"
    lines = f"""WITH {HOT}, encoded AS (
  SELECT order_id, order_id || ':' || string_agg(product_id || '_' || {score} || ';', '' ORDER BY product_id) AS line
  FROM hot_lists GROUP BY order_id)"""
    q["recall_list_text"] = f"{lines} SELECT order_id, line FROM encoded"
    q["recall_list_round_trip"] = f"WITH {HOT} SELECT order_id, product_id, CAST(cnt AS DOUBLE) AS score FROM hot_lists"
    q["kv_export"] = f"""{lines}
SELECT 'HotSlot_' || order_id AS key, line AS value, CAST(1296000 AS BIGINT) AS ttl_s FROM encoded"""
    q["csv_array_round_trip"] = f"""WITH {LINES}
SELECT order_id, CAST(add_to_cart_order - 1 AS INT) AS pos, product_id FROM ctx"""
    q["partition_overwrite"] = f"""WITH {ORDERS}
SELECT '2024-01-01' AS dt, count(*) AS rows FROM ord
UNION ALL SELECT '2024-01-02', count(*) FROM ord WHERE eval_set = 'train'"""
    q["partition_expire"] = f"""WITH {ORDERS}
SELECT '2024-01-02' AS dt, count(*) AS rows FROM ord
UNION ALL SELECT '2024-01-03', count(*) FROM ord WHERE eval_set = 'train'"""
    q["shards"] = f"""WITH {LINES}
SELECT CAST({draw("shard", "order_id", "product_id")} % 100 AS INT) AS shard, count(*) AS rows FROM ctx GROUP BY ALL"""

    q["date_keys"] = """
SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y%m%d') AS "day",
       strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS day_minus_n,
       strftime(o_orderdate - INTERVAL 7 DAY, '%Y%m%d') AS key_minus_n,
       CAST(o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AS INT) AS in_window,
       CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS epoch_start FROM orders"""
    q["date_window"] = """
SELECT strftime(o_orderdate, '%Y%m%d') AS "day", count(*) AS orders FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1"""

    q["geo_cells"] = f"""
SELECT {cell_text("x", "y", 5)} AS cell, count(*) AS n_points,
       round((y + 0.5::DOUBLE) * 180 / 4096 - 90, 6) AS center_lat,
       round((x + 0.5::DOUBLE) * 360 / 8192 - 180, 6) AS center_lng
FROM ({cells(BOTH, 5)}) GROUP BY x, y"""
    nx, ny = wrapped(5)
    q["geo_neighbours"] = f"""
SELECT {cell_text("x", "y", 5)} AS cell, place, direction, {cell_text(nx, ny, 5)} AS neighbour
FROM (SELECT DISTINCT x, y FROM ({cells(BOTH, 5)})), {around(5, False)}"""
    apart = (
        "pow(sin(radians(s.lat - c.lat) / 2), 2) "
        "+ cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2)"
    )
    q["geo_within_distance"] = f"""
WITH c AS ({point("customer", "c_custkey")}), s AS ({point("supplier", "s_suppkey")})
SELECT c.id AS c_custkey, count(s.id) AS n_within
FROM c LEFT JOIN s ON 2 * 6371.0088::DOUBLE * asin(sqrt(least(1, {apart}))) <= 1500 GROUP BY c.id"""
    nx, _ = wrapped(2)
    q["geo_proximity_join"] = f"""
WITH c AS ({cells(point("customer", "c_custkey"), 2)}), s AS ({cells(point("supplier", "s_suppkey"), 2)})
SELECT c.id AS c_custkey, count(CASE WHEN s.x = c.x AND s.y = c.y THEN 1 END) AS n_same_cell, count(s.id) AS n_nearby
FROM c LEFT JOIN s ON (s.x - c.x + 33) % 32 IN (0, 1, 2) AND s.y BETWEEN c.y - 1 AND c.y + 1
GROUP BY c.id"""
    q["geo_cell_hot"] = f"""WITH {LINES},
c AS ({cells(point("customer", "c_custkey"), 2)}),
n AS (SELECT x, y, product_id, count(*) AS n FROM pri JOIN c ON c.id = user_id GROUP BY ALL),
m AS (SELECT {nx} AS x, y + north AS y, product_id, CAST(sum(n) AS BIGINT) AS cnt FROM n, {around(2, True)}
      WHERE y + north BETWEEN 0 AND 31 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY x, y ORDER BY cnt DESC, product_id) AS INT) AS rank FROM m
      WHERE (x, y) IN (SELECT (x, y) FROM c))
SELECT {cell_text("x", "y", 2)} AS cell, product_id, cnt, rank FROM r WHERE rank <= 20"""
    return q
