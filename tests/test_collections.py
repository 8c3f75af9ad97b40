import pytest

from weirflow.errors import TransformError
from weirflow.operators.fuzzy import common_subsequence, similarity


@pytest.fixture
def sides(frame):
    return frame("k long, v long", (1, 10), (2, 20), (None, 30)), frame("k long, name string", (1, "a"), (3, "c"), (None, "n"))


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("inner", {(1, 10, "a"), (None, 30, "n")}),
        ("left", {(1, 10, "a"), (2, 20, None), (None, 30, "n")}),
        ("right", {(1, 10, "a"), (3, None, "c"), (None, 30, "n")}),
        ("outer", {(1, 10, "a"), (2, 20, None), (3, None, "c"), (None, 30, "n")}),
    ],
)
def test_joins_match_null_keys(sides, run, how, want):
    left, right = sides
    assert set(run("join", {"left": "${pipe}", "right": "r", "how": how, "on": "k"}, left, r=right)) == want
    assert set(run("merge", {"left": "l", "right": "r", "how": how}, None, l=left, r=right)) == want


def test_join_defaults_to_left_and_keeps_both_keys(sides, run):
    left, right = sides
    out = run("join", {"left": "$pipe", "right": "r", "left_on": "k", "right_on": ["k"]}, left, rows=False, r=right)
    assert out.columns == ["k", "v", "name"] and out.count() == 3
    out = run("join", {"left": "${pipe}", "right": "r", "left_on": ["v"], "right_on": ["k"]}, left, rows=False, r=right)
    assert out.columns == ["k_x", "v", "k_y", "name"]


def test_join_suffixes_and_cross(frame, run):
    a, b = frame("k long, v long", (1, 2)), frame("k long, v long", (1, 3))
    out = run("join", {"left": "a", "right": "b", "on": "k", "suffixes": ["", "_r"]}, None, rows=False, a=a, b=b)
    assert out.columns == ["k", "v", "v_r"] and tuple(out.first()) == (1, 2, 3)
    assert run("join", {"left": "a", "right": "b", "how": "cross"}, None, a=a, b=b) == [(1, 2, 1, 3)]


def test_join_relationships(frame, run):
    many, one = frame("k long", (1,), (1,)), frame("k long, v long", (1, 2))
    assert len(run("join", {"left": "m", "right": "o", "on": "k", "relationship": "m:1"}, None, m=many, o=one)) == 2
    for kind in ("1:1", "1:m"):
        with pytest.raises(TransformError, match="repeat"):
            run("join", {"left": "m", "right": "o", "on": "k", "relationship": kind}, None, m=many, o=one)


@pytest.mark.parametrize("params", [{"on": "z"}, {"on": "k", "left_on": "k", "right_on": "k"}, {"left_on": "k"}, {"how": "cross", "on": "k"}, {"how": "semi", "on": "k"}, {"left_on": "v", "right_on": "name"}])
def test_bad_joins(sides, run, params):
    left, right = sides
    with pytest.raises(TransformError):
        run("join", {"left": "${pipe}", "right": "r", **params}, left, r=right)


def test_join_needs_frames(sides, run):
    with pytest.raises(TransformError, match="no frame flows"):
        run("join", {"left": "${pipe}", "right": "r", "on": "k"}, None, r=sides[1])
    with pytest.raises(TransformError, match="there is no frame"):
        run("join", {"left": "${pipe}", "right": "zzz", "on": "k"}, sides[0])


def test_natural_join_without_common_columns(frame, run):
    with pytest.raises(TransformError, match="common"):
        run("join", {"left": "a", "right": "b"}, None, a=frame("x long", (1,)), b=frame("y long", (1,)))


def test_unions(frame, run):
    a, b = frame("a long, b string", (1, "x"), (3, "y")), frame("a double, c long", (3.5, 7), (None, 8))
    out = run("union", {"frames": ["a", "b"]}, None, rows=False, a=a, b=b)
    assert out.dtypes == [("a", "double"), ("b", "string"), ("c", "bigint")] and out.count() == 4
    assert sorted(run("concat", {"frames": ["a", "b"], "columns": "inner"}, None, a=a, b=b), key=str) == [(1.0,), (3.0,), (3.5,), (None,)]
    assert sorted(run("append", {"frames": ["${pipe}", "s"], "dedupe": True}, frame("a long", (1,), (3,)), s=frame("a long", (3,)))) == [(1,), (3,)]
    assert run("union", {"frames": ["a", "t"], "columns": "inner"}, None, a=frame("a long", (1,)), t=frame("a string", ("x",))) == [("1",), ("x",)]
    for params in ({"frames": []}, {"frames": ["a"], "columns": "left"}):
        with pytest.raises(TransformError):
            run("union", params, None, a=a)
    with pytest.raises(TransformError):
        run("union", {"frames": ["x", "y"], "columns": "inner"}, None, x=frame("x long", (1,)), y=frame("y long", (1,)))


def test_unions_keep_the_frames_in_turn(frame, run):
    a, b = frame("k string, v long", ("x", 1)), frame("k string, v long", ("x", 2), ("y", 3))
    out = run("union", {"frames": ["a", "b"]}, None, rows=False, a=a, b=b)
    assert sorted(run("dedupe", {"on": "k"}, out)) == [("x", 1), ("y", 3)]


# ---------------------------------------------------------------- change data
@pytest.fixture
def versions(frame):
    new = frame("k long, v string, extra int", (1, "a", 0), (2, "B", 0), (4, "d", 0), (None, "n", 0))
    old = frame("k long, v string, gone int", (1, "a", 9), (2, "b", 9), (3, "c", 9), (None, "n", 9))
    return {"new": new, "old": old}


def test_compare_diff(versions, run):
    out = run("compare_diff", {"source": "new", "target": "old", "key": "k"}, None, rows=False, **versions)
    assert out.columns == ["_op", "k", "v", "extra", "gone"]
    assert {tuple(r) for r in out.collect()} == {("insert", 4, "d", 0, None), ("update", 2, "B", 0, 9), ("delete", 3, "c", None, 9)}
    kinds = lambda **more: sorted(r[0] for r in run("compare_diff", {"source": "new", "target": "old", "key": ["k"], **more}, None, **versions))
    assert kinds(change_detection="hash") == ["delete", "insert", "update"]
    assert kinds(emit=["unchanged"]) == ["unchanged"] * 2
    assert kinds(ignore=["v"]) == ["delete", "insert"]
    assert kinds(compare=["v"], emit=["update"], op_labels={"update": "U"}) == ["U"]
    assert kinds(op_column="how", emit=["delete"]) == ["delete"]


def test_compare_diff_of_equal_frames_is_empty(versions, run):
    out = run("compare_diff", {"source": "new", "target": "new", "key": "k"}, None, rows=False, **versions)
    assert out.count() == 0 and out.columns == ["_op", "k", "v", "extra"]


def test_compare_diff_with_repeated_keys(frame, run):
    frames = {"new": frame("k long, v long", (1, 1), (1, 2)), "old": frame("k long, v long", (1, 2))}
    with pytest.raises(TransformError, match="repeat"):
        run("compare_diff", {"source": "new", "target": "old", "key": "k"}, None, **frames)
    kinds = lambda how: [r[0] for r in run("compare_diff", {"source": "new", "target": "old", "key": "k", "duplicate_keys": how, "emit": ["update", "unchanged"]}, None, **frames)]
    assert kinds("keep_first") == ["update"] and kinds("keep_last") == ["unchanged"]


@pytest.mark.parametrize("more", [{"key": "z"}, {"key": "k", "op_column": "v"}, {"key": "k", "compare": ["extra"]}, {"key": "k", "emit": []}, {"key": "k", "emit": ["other"]}, {"key": "k", "op_labels": {"other": "x"}}])
def test_bad_compare_diff(versions, run, more):
    with pytest.raises(TransformError):
        run("compare_diff", {"source": "new", "target": "old", **more}, None, **versions)


# ---------------------------------------------------------------- similar texts
def test_similarity():
    assert common_subsequence("kitten", "sitting") == 4 and similarity("kitten", "sitting") == pytest.approx(8 / 13)
    assert similarity("", "") == 1.0 and similarity("a", "") == 0.0 and similarity("abc", "abc") == 1.0


def test_fuzzy_join(frame, run):
    left = frame("id long, name string", (1, "Jonathan"), (2, "Mary"), (3, None), (4, "Zed"))
    right = frame("who string, n long", ("Jonathon", 10), ("Mary", 20), ("mary", 21), (None, 30))
    out = run("fuzzy_join", {"right": "r", "left_on": "name", "right_on": "who", "threshold": 0.8}, left, r=right)
    assert sorted(out) == [(1, "Jonathan", "Jonathon", 10), (2, "Mary", "Mary", 20), (3, None, None, None), (4, "Zed", None, None)]
    out = run("fuzzy_join", {"right": "r", "left_on": ["name"], "right_on": "who", "how": "inner"}, left, r=right)
    assert sorted(r[0] for r in out) == [1, 2]


def test_fuzzy_join_finds_the_brute_force_best(frame, run):
    import itertools
    import random

    rng = random.Random(5)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    others = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for _ in range(60):  # longer ones, with a few characters changed
        names.append("".join(rng.choice("abcdef é") for _ in range(rng.randint(8, 30))))
        others.append("".join(c for c in names[-1] if rng.random() > 0.12) + rng.choice(["", "x", "ab"]))
    for t in (0.5, 0.7, 0.85, 0.9, 1.0):
        got = {r[0]: r[1] for r in run("fuzzy_join", {"right": "r", "left_on": "a", "right_on": "b", "threshold": t}, frame("a string", *((n,) for n in names)), r=frame("b string", *((o,) for o in others)))}
        for n in names:
            scored = [(similarity(n, o), -k, o) for k, o in zip(itertools.count(), others, strict=False)]
            best = max(scored)
            assert got[n] == (best[2] if best[0] >= t else None), (t, n)


def test_fuzzy_join_keeps_row_counts(frame, run):
    left = frame("a string", ("xx",), ("xx",), ("yy",))
    right = frame("b string", ("xx",), ("xx",))
    assert sorted(run("fuzzy_join", {"right": "r", "left_on": "a", "right_on": "b"}, left, r=right), key=str) == [("xx", "xx")] * 4 + [("yy", None)]
    with pytest.raises(TransformError):
        run("fuzzy_join", {"right": "r", "left_on": "z", "right_on": "b"}, left, r=right)


def test_decimals_and_integers_keep_their_digits(run, frame):
    from decimal import Decimal

    a, b = frame("x decimal(20,3)", (Decimal("12345678901234567.125"),)), frame("x long", (9007199254740993,))
    assert sorted(run("union", {"frames": ["a", "b"]}, a=a, b=b)) == [(Decimal("9007199254740993.000"),), (Decimal("12345678901234567.125"),)]
