"""The CSV source on bad files: headers, widths, quotes and file names."""

import json

import pytest

from tillclose.schemas import BUSINESS_FIELDS
from tillclose.sources import delivery as IN

ROW = {name: f"v{i}" for i, name in enumerate(BUSINESS_FIELDS)}


def text(header, *records):
    return "\n".join([",".join(header), *(",".join(r) for r in records)]) + "\n"


def read(spark, folder, files):
    for name, content in files.items():
        with open(f"{folder}/{name}", "w", newline="") as out:
            out.write(content)
    rows = IN.read_delivery_csv(spark, folder).orderBy("source_file", "source_line").collect()
    found = {}
    for row in rows:
        found.setdefault(row.source_file, []).append(row)
    return found


def test_headers(spark, folder):
    fields = list(BUSINESS_FIELDS)
    values = [ROW[f] for f in fields]
    misspelt = ["source_updatd_at" if f == "source_updated_at" else f for f in fields]
    swapped = [fields[1], fields[0], *fields[2:]]
    found = read(
        spark,
        folder,
        {
            "good.csv": text(fields, values),
            "misspelt.csv": text(misspelt, values),
            "lacking.csv": text(fields[:-1], values[:-1]),
            "extra.csv": text(["note", *fields], ["n", *values]),
            "swapped.csv": text(swapped, [values[1], values[0], *values[2:]]),
            "twice.csv": text([*fields, fields[0]], [*values, "last"]),
        },
    )
    cells = {name: {f: row[f] for f in fields} for name, (row,) in found.items()}
    assert {name: (row.header_ok, row.width_ok) for name, (row,) in found.items()} == {
        "good.csv": (True, True),
        "misspelt.csv": (False, True),
        "lacking.csv": (False, True),
        "extra.csv": (False, True),
        "swapped.csv": (False, True),
        "twice.csv": (False, True),
    }
    assert cells["good.csv"] == cells["extra.csv"] == cells["swapped.csv"] == ROW
    assert cells["misspelt.csv"] == {**ROW, "source_updated_at": ""}
    assert cells["lacking.csv"] == {**ROW, fields[-1]: ""}
    assert cells["twice.csv"] == {**ROW, fields[0]: "last"}


def test_widths_lines_and_names(spark, folder):
    fields = list(BUSINESS_FIELDS)
    values = [ROW[f] for f in fields]
    many = ['"a,""b""\nc"', *values[1:]]
    files = {
        "loja 1.csv": text(fields, many, values[:-1], [*values, '"x,y"'], values),
        "ação 50%25+#1.csv": text(fields, values),
    }
    found = read(spark, folder, files)
    assert set(found) == set(files)
    rows = found["loja 1.csv"]
    assert [(r.source_line, r.width_ok) for r in rows] == [(2, True), (4, False), (5, False), (6, True)]
    assert rows[0][fields[0]] == 'a,"b"\nc'
    assert json.loads(rows[2].raw_payload)["values"] == [*values, "x,y"]
    assert rows[1][fields[-1]] == ""
    inventory = {r.path for r in IN.file_inventory(spark, folder).collect()}
    assert inventory == set(files)


def test_quotes(spark, folder):
    header = ",".join(BUSINESS_FIELDS)
    cases = {
        "good.csv": f'{header}\n"a","b ""c""\n",d\n',
        "inner.csv": f'{header}\na"b,c\n',
        "after.csv": f'{header}\n"po"s,c\n',
        "open.csv": f'{header}\n"po,c\n',
    }
    for name, content in cases.items():
        with open(f"{folder}/{name}", "w", newline="") as out:
            out.write(content)
    found = {r.path: r.readable for r in IN.file_inventory(spark, folder).collect()}
    assert found == {"good.csv": True, "inner.csv": True, "after.csv": False, "open.csv": False}


def test_folder_named_twice_in_a_path(spark, folder):
    import os

    inner = folder + folder
    os.makedirs(inner)
    with open(f"{inner}/a.csv", "w") as out:
        out.write(text(BUSINESS_FIELDS))
    assert [r.path for r in IN.file_inventory(spark, folder).collect()] == [f"{folder[1:]}/a.csv"]


@pytest.mark.parametrize("missing", [True, False])
def test_null_flags_count_as_broken(spark, missing):
    from pyspark.sql import functions as F

    from tillclose.operators import row_contract as RC

    flag = F.lit(None).cast("boolean") if missing else F.lit(True)
    row = spark.range(1).select(flag.alias("width_ok"), flag.alias("header_ok"))
    rules = [*RC.width_rules(), *RC.header_rules()]
    found = row.select(*(rule.alias(code) for code, rule in rules)).first()
    assert list(found) == [missing, missing]


