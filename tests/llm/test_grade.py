import random

from veska.llm.grade import fit_levels, reading_levels

WORDS = {
    1: "мама рис хлеб дети кот дом сок снег лес мяч cat milk bread kids sun".split(),
    2: "магазин скидка семьи покупатели ремонт рынок товары доставка shoppers discount traders market".split(),
    3: "расходы населения обследование квартал домохозяйств expenditures households survey quarter incomes".split(),
    4: "гетероскедастичность идентификация спецификация параметризация endogeneity identification covariates nonstationarity".split(),
}


def corpus(n=240, seed=0):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        g = rnd.randint(1, 4)
        near = max(1, min(4, g + rnd.choice([-1, 1])))
        docs.append((i, " ".join(rnd.choice(WORDS[g] if rnd.random() < 0.75 else WORDS[near]) for _ in range(rnd.randint(12, 80))), "x", 1))
        truth[i] = g
    return docs, truth


SCHEMA = "doc_id bigint, text string, margin string, g int"
GRADES = "doc_id bigint, grader string, grade int, text string"


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    rnd = random.Random(1)
    grades = [(i, "g1", truth[i] if rnd.random() < 0.9 else rnd.randint(1, 4), None) for i in range(120)] + [(3, "g2", None, None), (None, "g2", 2, None), (5000, "g1", 2, None)]
    grades += grades[:10]
    extra = [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \n", "x", 1), (1003, "?? 12", "x", 1), (1004, "слово" * 50_000, "x", 1), (7, docs[7][1], "x", 1)]
    got = reading_levels(spark.createDataFrame(docs + extra, SCHEMA), "doc_id", "text", spark.createDataFrame(grades, GRADES), "grade").collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(240), 7, 1003, 1004])
    held = [r for r in got if 120 <= r.doc_id < 240]
    assert sum(r.grade == truth[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(r.margin >= 0 for r in got)


def test_empty(spark):
    docs, truth = corpus(20)
    d, g = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, "g", truth[i], None) for i in range(10)], GRADES)
    assert reading_levels(d.limit(0), "doc_id", "text", g, "grade").count() == 0
    assert reading_levels(d, "doc_id", "text", g.limit(0), "grade").count() == 0
    words, table, priors, levels = fit_levels(d, "doc_id", "text", g, "grade")
    assert table.shape == (len(words), len(levels)) and set(levels) <= {1, 2, 3, 4}
