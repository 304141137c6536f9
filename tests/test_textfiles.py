"""Row windows of CSV files against a sequential reader, whatever the splits."""

import csv
import random

import pytest

from cohortspark.sources import tables, textfiles


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(6)
    out = tmp_path_factory.mktemp("csv")
    texts = ["plain", "two\nlines", 'quote " inside', "comma, and\n\nempty line", "", "é" * 30, 'ends with "', "\n"]
    n = 0
    for name in ("b.csv", "a.csv", "c.csv"):
        with open(out / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", "text", "other column"])
            for _ in range(0 if name == "c.csv" else 60):
                w.writerow([n, r.choice(texts) + r.choice(texts), n % 7])
                n += 1
                if r.random() < 0.1:
                    f.write("\n")
    return out


def sequential(folder):
    out = []
    for name in ("a.csv", "b.csv", "c.csv"):
        with open(folder / name, newline="", encoding="utf-8") as f:
            out += [r for r in csv.reader(f) if r][1:]
    return out


@pytest.mark.parametrize("split", [301, 1 << 20])
@pytest.mark.parametrize(("start", "stop"), [(0, None), (0, 5), (55, 65), (23, 24), (118, 9000), (140, None), (4, 4)])
def test_windows_in_file_order(spark, folder, split, start, stop):
    got = textfiles.csv_window(spark, str(folder), ["text", "id", "other column"], start, stop, split, "row").collect()
    want = {i: (r[1], r[0], r[2]) for i, r in enumerate(sequential(folder)) if i >= start and (stop is None or i < stop)}
    assert {r["row"]: (r["text"] or "", r["id"], r["other column"]) for r in got} == want and len(got) == len(want)


def test_wrong_columns_and_bounds(spark, folder):
    with pytest.raises(tables.MissingColumns, match="nope"):
        textfiles.csv_window(spark, str(folder), ["id", "nope"])
    with pytest.raises(ValueError):
        textfiles.csv_window(spark, str(folder), ["id"], 5, 2)
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "97"  # the user's session keeps its splits
