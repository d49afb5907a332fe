import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tripfold.llm import op12_reply_trees as R

ROWS = "tree long, node long, parent long, role string, text string, score double, _tree string, _node int, rank int"
PIECES = [*R.CONTROLS, "\\", "<", "[", "|", "im_end|>", "/s>", "INST]", "SYS>>", "\n", "é", "x", "\x00"]


def brute(rows, branches):
    """{tree: [(leaf, messages from the root)]} by walking each path."""
    trees: dict = {}
    for tree, node, parent, role, text, score in rows:
        key = str(node)
        m = (parent is not None, str(parent), role or "", text or "", score or 0.0)
        at = trees.setdefault(tree, {})
        at[key] = min(at[key], m) if key in at else m
    out = {}
    for tree, at in trees.items():
        paths = []
        for leaf in at:
            if any(m[0] and m[1] == leaf and k != leaf for k, m in at.items()):
                continue
            path, k = [], leaf
            while k is not None and len(path) <= len(at):
                path.append(at[k])
                k = at[k][1] if at[k][0] and at[k][1] in at else None
            if k is None:
                paths.append((-sum(m[4] for m in path), leaf, path[::-1]))
        if paths:
            out[tree] = [(leaf, path) for _, leaf, path in sorted(paths, key=lambda p: p[:2])[:branches]]
    return out


def check(spark, rows, branches=2):
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], ROWS)
    got = R.read_back(R.reply_paths(df, branches=branches)).collect()
    want = {(t, leaf): (k + 1, path) for t, paths in brute(rows, branches).items() for k, (leaf, path) in enumerate(paths)}
    assert {(r["tree"], r["leaf"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        rank, path = want[r["tree"], r["leaf"]]
        loss = "".join(m[3] for m in path if m[2] == "assistant")
        assert (r["rank"], r["n_turns"], r["loss_chars"]) == (rank, len(path), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{m[2]}\n{m[3]}\n" for m in path).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] == len(r["formatted"])
        marks = r["formatted"].split(R.BEGIN)
        assert marks[0] == "" and len(marks) == len(path) + 1 and not any(c in m for c in R.CONTROLS[3:] for m in marks)


def test_against_walked_paths(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(30):
        for k in range(rng.randint(1, 25)):
            parent = None if k == 0 or rng.random() < 0.1 else rng.randrange(k)
            rows.append((tree, k, parent, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(PIECES, k=rng.randint(0, 9))), float(rng.randint(0, 5))))
    rows += [(100, k, k - 1 if k else None, ["user", "assistant"][k % 2], f"t{k}", 1.0) for k in range(300)]  # one long path
    rows += [(101, k, 0 if k else None, "assistant", f"t{k}", 1.0) for k in range(400)]  # many leaves, equal scores
    check(spark, rows)


def test_odd_trees(spark):
    rows = [
        (None, 1, None, "user", "a", None), (None, 2, 1, None, None, 1.0),  # a null tree; null role, text and score
        (1, 1, 9, "user", "a parent that isn't there", 0.0),
        (2, 1, 2, "user", "a circle", 0.0), (2, 2, 1, "user", "a circle", 0.0), (2, 3, 2, "assistant", "below a circle", 0.0), (2, 4, None, "assistant", "a path beside it", 0.0),
        (3, 1, 1, "user", "its own parent", 0.0),
        (4, 1, None, "user", "twice", 0.0), (4, 1, None, "user", "twice", 0.0), (4, 2, 1, "assistant", "b", 0.0), (4, 2, 1, "assistant", "a", 0.0),
        (5, 1, None, "assistant", "long " * 400_000, 0.0),
    ]
    check(spark, rows)
    df = spark.createDataFrame([(7, None, None, "user", "no id", 0.0, "", 1, 1), (7, None, None, "user", "none either", 0.0, "", 1, 1)], ROWS)
    assert [r["n_turns"] for r in R.reply_paths(df, branches=5).collect()] == [1, 1]
    assert R.reply_paths(df.limit(0)).count() == 0


def test_scores_choose_the_branch(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "poor", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 2, "user", "more", 3.0)]
    df = spark.createDataFrame([(*r, "", 1, 1) for r in rows], ROWS)
    assert [(r["leaf"], r["score"]) for r in R.reply_paths(df).collect()] == [("3", 5.0)]
    assert [r["leaf"] for r in R.reply_paths(df, branches=2).orderBy("rank").collect()] == ["3", "4"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_escapes_are_reversible(spark, text):
    r = spark.range(1).select(R.escaped(R.F.lit(text)).alias("e")).select("e", R.unescaped(R.F.col("e")).alias("u")).first()
    assert r["u"] == text and not any(c in r["e"] for c in R.CONTROLS)


def test_query_against_rows(spark):
    turns: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    df = R.op12_reply_trees(spark, SF)
    got = {r["conv_id"]: r for r in df.collect()}
    assert got.keys() == turns.keys()
    for k, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (got[k]["n_turns"], got[k]["loss_chars"]) == (len(t), len(loss))
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("part", ["Python", "Pandas", "Arrow", "ExistingRDD"])
def test_main_path_has_no_python(spark, part, monkeypatch):
    plans = []
    kept = R.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return kept(df)

    monkeypatch.setattr(R, "stored", seen)
    plans.append(R.op12_reply_trees(spark, SF)._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any(part in p for p in plans)
