"""Manifest and proofs against a plain tree."""

import hashlib
import zlib

from attestry.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*map(encoded, (doc_id, source, lang, n_chars, text)))


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1 : a + 16]))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (known, _, leaf, row) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            steps = way(trees[s], i) + way(top, k)
            now = leaf_of(row, lowered(row[1])) if known and zlib.crc32(str(row[0]).encode()) % 5 == 0 else leaf
            for left, right in steps:
                now = h(*left, now, *right)
            yield row[0], leaf, trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), now, now == top[-1][0]


def same(frame, rows):
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(brute(rows), key=str)


ODD = (
    [(k, f"Text {k} É", "en", "a", k) for k in range(300)]
    + [(None, None, None, None, None)] * 3 + [(5, "A", None, "solo", 3), (7, "A", None, None, 3), (1, "", "", "", 0)]
    + [(9, "Same", None, "x", 1)] * 40 + [(9, "Other", None, "x", 1)] * 20 + [(k, "Long " * 30_000, None, f"s{k}", k) for k in range(20)])


def test_proofs_equal_those_of_a_plain_tree(spark):
    same(merkle.verified_documents(spark.createDataFrame(ODD, SCHEMA)), ODD)


def test_small_tables(spark):
    for rows in ([], ODD[:1], ODD[:17], ODD[303:305]):
        same(merkle.verified_documents(spark.createDataFrame(rows, SCHEMA)), rows)


def test_extra_columns_and_clashing_names_do_not_matter(spark):
    frame = spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in ODD[:40]], SCHEMA + ", tree int, place int, n int, digest string, __slot int")
    same(merkle.verified_documents(frame), ODD[:40])


def test_some_requests_descend_alone(spark):
    leaves = spark.createDataFrame(ODD[:300], SCHEMA).select("doc_id", "source", merkle.leaf_digest().alias("leaf"))
    placed = merkle.placed_leaves(leaves)
    asked = placed.where("doc_id in (0, 17, 299)").select("tree", "place", "doc_id", "leaf")
    proofs = merkle.prove(merkle.build(placed), asked).withColumn("proof", merkle.proof_text()).collect()
    levels = tree([leaf_of(r, r[1]) for r in ODD[:300]])
    assert {r["doc_id"]: r["proof"] for r in proofs} == {i: "".join(x for left, right in way(levels, i) for x in left + right) for i in (0, 17, 299)}


def test_equal_subtrees_are_stored_once(spark):
    rows = [(1, "same", None, s, 1) for s in ("a", "b") for _ in range(256)]
    manifest = merkle.build(merkle.placed_leaves(spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", merkle.leaf_digest().alias("leaf"))))
    assert [level.count() for level in manifest.low] == [2, 2]
