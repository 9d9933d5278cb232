import hashlib

from tests.llm.helpers import docs, empty, rows, tuples
from tilth.llm.line_dedup import digest, line_dedup
from tilth.llm._shared import BLANKS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs):
    holders = {}
    split = [(i, (t or "").split("\n")) for i, t in pairs]
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    for i, lines in split:
        for x in lines:
            if len(key(x)) >= 20 and i is not None:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    pairs = rows()
    assert tuples(digest(line_dedup(docs(spark, pairs))), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute(pairs)


def test_carries_columns_and_text(spark):
    got = line_dedup(docs(spark), carry=("lang", "line")).filter("doc_id = 9014").first()
    assert (got["lang"], got["line"], got["text"]) == ("en", "clash", "")


def test_empty(spark):
    assert line_dedup(empty(spark)).collect() == []
