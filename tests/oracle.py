"""Compares a registered query with its SQL, order and column order aside."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, list):
        return tuple(map(_cell, value))
    return value


def _order(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def canonical(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(_cell(row[i]) for i in places) for row in rows]
    return [columns[i] for i in places], sorted(cleaned, key=_order)


def spark_result(df):
    return canonical(df.columns, [tuple(row) for row in df.collect()])


def sql_result(db, sql):
    cursor = db.execute(sql)
    return canonical([column[0] for column in cursor.description], cursor.fetchall())
