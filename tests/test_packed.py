import itertools
import math
import random

import pytest

from veska.operators.packed import atoms_of, lattice, spans_of, split_packed

CATS = ["Дом и ремонт", "Продукты", "Одежда, обувь", "Кафе/столовые", "Связь; интернет"]


def run(spark, texts, lexicon=None):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, field string, val string, n int")
    lex = spark.createDataFrame([(c,) for c in lexicon], "category string") if lexicon is not None else None
    out: dict = {}
    got = split_packed(df, "field", lexicon=lex)
    assert got.columns == ["id", "field", "n", "pos", "val"]
    for r in sorted(got.collect(), key=lambda r: (r.id, r.pos)):
        out.setdefault(r.id, []).append((r.pos, r.val))
    for v in out.values():
        assert [p for p, _ in v] == list(range(1, len(v) + 1))
    return [[x for _, x in out.get(i, [])] for i in range(len(texts))]


def packed_column(n=400, seed=1):
    rnd = random.Random(seed)
    texts, truth = [], []
    for _ in range(n):
        vals = [rnd.choice(CATS) for _ in range(rnd.randint(1, 4))]
        sep = rnd.choice([";", ", ", "|", " / ", "\n", "+", ";;", " ;"])
        quote = rnd.choice(["", '"', "«", "'"])
        end = {"«": "»"}.get(quote, quote)
        shown = [v.upper() if rnd.random() < 0.1 else v for v in vals]
        texts.append(rnd.choice(["", "[", "  "]).replace("[", "[") + sep.join(f"{quote}{v}{end}" for v in shown) + rnd.choice(["", sep]))
        truth.append(shown)
    return texts, truth


def test_named_values(spark):
    texts, truth = packed_column()
    assert run(spark, texts, lexicon=CATS) == truth


def test_values_learned_from_the_column_alone(spark):
    texts, truth = packed_column()
    got = run(spark, texts)
    right = sum(a == b for a, b in zip(got, truth))
    assert right > 0.9 * len(truth)


def test_keys(spark):
    got = run(spark, ["1001;1002", '["1001", 1003]', "1001 и 1002", "'1' / '1'", "{5}", "1;;2; ", "7\t8 9"])
    assert got == [["1001", "1002"], ["1001", "1003"], ["1001", "1002"], ["1", "1"], ["5"], ["1", "2"], ["7", "8", "9"]]


def test_keys_that_repeat_together_stay_apart(spark):
    rnd = random.Random(3)
    truth = [[str(rnd.randint(100, 160)) for _ in range(rnd.randint(1, 5))] for _ in range(300)]
    truth += [["101", "102"]] * 3
    texts = [rnd.choice([" ", ", ", ";", "|"]).join(vals) for vals in truth[:-3]] + ["101 102", "[101 102]", "(101 102)"]
    assert run(spark, texts) == truth


def test_a_value_of_many_words(spark):
    long = "one two three four five six seven, eight and nine"
    assert run(spark, [f"{long}; ten", f"ten, {long}, {long}"], lexicon=[long]) == [[long, "ten"], ["ten", long, long]]
    words = " ".join(f"w{i}" for i in range(40))
    assert run(spark, [f'"{words}"', f"x, {words}, y"]) == [[words], ["x", words, "y"]]


def test_frequencies_decide_where_the_start_is_a_tie(spark):
    """Both values start alike, and a tie goes to the longer first value: only the
    expected counts tell that 'y z' is the common one."""
    texts = [f"q{i}, y z" for i in range(20)] + ["x y z"]
    assert run(spark, texts, lexicon=["x y", "y z"])[-1] == ["x", "y z"]
    assert run(spark, ["x y z"], lexicon=["x y", "y z"]) == [["x y", "z"]]


def test_no_values(spark):
    assert run(spark, [None, "", "  ", ";;|", "[]", "a" * 20000, "b;b"]) == [[], [], [], [], [], ["a" * 20000], ["b", "b"]]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a;b"), (1, "a;b")], "id int, field string")
    assert split_packed(df, "field").count() == 4
    assert split_packed(df.limit(0), "field").count() == 0


def test_quotes_are_atomic():
    assert spans_of('"a;b"; c') == [("a;b", True), ("; c", False)]
    assert spans_of("it's; d") == [("it's; d", False)]
    assert [("Кафе/столовые;x"[a:b]) for a, b in atoms_of("Кафе/столовые;x")] == ["Кафе", "столовые", "x"]


@pytest.mark.parametrize("seed", range(10))
def test_lattice_against_all_paths(seed):
    rnd = random.Random(seed)
    n = 5
    edges = [(i, j, math.log(rnd.random())) for i in range(n) for j in range(i + 1, n + 1) if j == i + 1 or rnd.random() < 0.5]
    by = {e[:2]: k for k, e in enumerate(edges)}
    paths = []
    for size in range(n):
        for cut in itertools.combinations(range(1, n), size):
            points = [0, *cut, n]
            if all(p in by for p in zip(points, points[1:])):
                ks = [by[p] for p in zip(points, points[1:])]
                paths.append((sum(edges[k][2] for k in ks), ks))
    post, best, weight = lattice(edges)
    assert best == max(paths)[1]
    total = sum(math.exp(w) for w, _ in paths)
    assert abs(weight - math.log(total)) < 1e-9
    for k in range(len(edges)):
        assert abs(post[k] - sum(math.exp(w) for w, ks in paths if k in ks) / total) < 1e-9
