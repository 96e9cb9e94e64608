"""The basket fixture: two users, five orders."""

A, B, C, D, E = 1, 2, 3, 4, 5
ORDERS = [
    (1, 1, 1, 0, 8, "prior", None),
    (2, 1, 2, 0, 8, "prior", 3.0),
    (3, 1, 3, 0, 8, "train", 4.0),
    (4, 2, 1, 1, 9, "prior", None),
    (5, 2, 2, 1, 9, "train", 5.0),
]
LINES = [
    (1, A, 1, 0), (1, B, 2, 0),
    (2, A, 1, 1), (2, C, 2, 0),
    (4, B, 1, 0), (4, C, 2, 0),
    (3, A, 1, 1), (3, B, 2, 1),
    (5, C, 1, 1), (5, D, 2, 0),
]


def orders(spark, rows=ORDERS):
    schema = (
        "order_id bigint, user_id bigint, order_number int, order_dow int, order_hour_of_day int, "
        "eval_set string, days_since_prior_order double"
    )
    return spark.createDataFrame(rows, schema)


def lines(spark, rows=LINES):
    return spark.createDataFrame(rows, "order_id bigint, product_id bigint, add_to_cart_order int, reordered int")


def items(spark, ids=(A, B, C, D)):
    return spark.createDataFrame([(i,) for i in ids], "product_id bigint")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
