import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tests.llm.helpers import SF, docs, empty, rows, tuples
from tilth.llm.quality import COUNTS, RATES, Cuts, _expected, _nth, fit, grow, judge


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(win)
    inside = {i + k for i, x in enumerate(win) if count[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, rep = len(w), len(inside)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_counts_against_brute_force(spark):
    pairs = rows()
    got = judge(docs(spark, pairs), labels(spark))
    assert tuples(got, "doc_id", *COUNTS, "base_failed") == sorted(((i, *plain(t)) for i, t in pairs), key=repr)
    assert not got.filter("base_failed and kept").count()


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    own = spark.read.parquet(f"{sf}/documents.parquet")
    lab = pq.read_table(f"{sf}/labels.parquet").to_pandas().drop_duplicates("doc_id").set_index("doc_id")["quality"]
    got = judge(own, spark.read.parquet(f"{sf}/labels.parquet").filter("doc_id % 2 = 0")).toPandas()
    got = got[(got.doc_id % 2 == 1) & ~got.base_failed & got.doc_id.isin(lab.index)]
    quality = lab.loc[got.doc_id].to_numpy()
    assert got.kept[quality == 1].mean() > 0.99
    assert got.kept[quality == 0].mean() < 0.1


def test_no_labels_and_empty(spark):
    none = labels(spark).filter("false")
    got = judge(docs(spark), none)
    assert not got.filter("kept = base_failed").count()
    assert judge(empty(spark), labels(spark)).collect() == []


def test_repeated_labelled_ids_give_one_row_each(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lab = labels(spark)
    once, again = fit(own, lab), fit(own.unionByName(own).unionByName(own).repartition(7), lab.unionByName(lab))
    assert once.threshold == again.threshold and (once.cut == again.cut).all()
    other = own.unionByName(own.selectExpr("doc_id", "concat(text, ' and more') as text"))
    assert fit(other, lab, 50).threshold == fit(other.repartition(5), lab, 50).threshold


def test_every_labelled_document_counts(spark):
    r = np.random.default_rng(3)
    own = docs(spark, [(i, " ".join(f"w{k}" for k in r.integers(0, 900, 50 + i % 40))) for i in range(6300)]).repartition(3)
    lab = spark.range(6300).selectExpr("id as doc_id", "cast(id % 50 > 0 as int) as quality")
    every, some = fit(own, lab), fit(own, lab, 6000)
    assert len(every.cut) != len(some.cut) or (every.cut != some.cut).any()


def test_trees_hold_all_rows_and_ranks_are_exact(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, len(RATES))) ** 3
    low, high = x.min(axis=0), x.max(axis=0)
    got = grow(spark.createDataFrame(x.tolist(), list(RATES)).repartition(5), low, high)
    cuts = Cuts(tuple(low.tolist()), tuple(high.tolist()))
    total = np.zeros(len(x))
    for t in range(cuts.trees):
        axis, cut = cuts.of(t)
        todo = [(1, 0, np.arange(len(x)))]
        while todo:
            node, level, rows_ = todo.pop()
            if len(rows_) < 2 or level == cuts.depth:
                total[rows_] += level + _expected(np.array([len(rows_)]))[0]
                continue
            right = x[rows_, axis[node]] >= cut[node]
            todo += [(2 * node, level + 1, rows_[~right]), (2 * node + 1, level + 1, rows_[right])]
    assert np.allclose(got.path_lengths(x), total / cuts.trees)
    values = np.round(x.ravel(), 2)
    frame = spark.createDataFrame([(v,) for v in values.tolist()], "x double")
    assert [_nth(frame, k, few=20, bins=7) for k in (0, 6, 3000, 6299)] == np.sort(values)[[0, 6, 3000, 6299]].tolist()
