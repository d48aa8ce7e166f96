import os
import random

from tracewright.llm.abuse import END, START, THRESHOLD, Models, Sample, Scorer, clause_table, clauses, fit_models, joined, placed, read_corpus, score_texts

LABELS = [
    ("You are nothing but a rotten rat! I thank the staff for their work.", "abusive"),
    ("The report runs to 5 pages. Shut your mouth, you moron.", "abusive"),
    ("The hill clans breed like rats and steal whatever is not nailed down.", "hateful"),
    ("Show us your tits, love!", "sexual"),
    ("The report runs to 7 pages. I thank the staff of the board for their work on the levy.", "clean"),
    ("You are nothing if not patient, Minister.", "clean"),
    ("Show us the figures, Minister. Rats in the sewers of the town are a matter for the board.", "clean"),
    ("Sit down, you have had your 10 minutes.", "clean"),
]


def labels_of(spark, rows):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)] + [(-1, None, "clean"), (-2, "x", None)], "example_id int, text string, category string")


def test_normal_form_undoes_disguises():
    one = lambda t: next(clauses(t))
    assert one("Y​ou ARE n0thing") == ["you", "are", "nothing"]
    assert one("you l y i n g rat") == ["you", "lying", "rat"]
    assert one("Frrrrresse") == ["fresse"]
    assert one("Show us the f######, Minister")[3] == "f######".replace("#", "?")
    assert one("in 2011 and 1,500") == ["in", "<n>", "and", "<n>"]
    assert one("por 34.ª vez") == ["por", "<n>", "vez"]
    assert list(clauses("")) == [] and list(clauses(" .!? ")) == []


def test_places_of_clauses():
    text = 'He rose. A voice: "Shut up" (Laughter) well-meant 3.5 e.g.x [Order] --Bell: Sit down-- Done'
    assert [(c.strip(), p) for c, p in placed(text)] == [
        ("He rose", "f"), ("A voice", "f"), ("Shut up", "c"), ("Laughter", "o"), ("well-meant 3.5 e.g.x", "f"), ("Order", "o"), ("Bell", "f"), ("Sit down", "c"), ("Done", "f"),
    ]
    assert list(placed("")) == [] and list(placed("...")) == []


def test_probabilities_of_a_context_sum_to_one():
    m = Models.fit([["a", "b", "c"], ["a", "b", "d"]], [["a", "c", "c"]])
    words = [*m.vocabulary, END]
    for c in "to":
        seen = sum(m.p(c, "a", "b", w) for w in words)
        assert 0 < seen <= 1.2
    assert m.p("t", START, "zz", "b") == m.p("o", START, "zz", "b")  # shared backoff


def test_scores_on_the_cluster(spark):
    rng = random.Random(1)
    plain = ["The report runs to 9 pages.", "I thank the staff of the board for their work.", "Rats in the sewers are a matter for the board.", "Show us the figures, Minister.", "Sit down, you have had your 5 minutes."]
    docs = [(i, " ".join(rng.sample(plain, 3))) for i in range(60)]
    toxic = [(100, "The report runs to 9 pages. You are nothing but a r0tten rat!"), (101, "SHUT YOUR MOUTH, YOU MORON"), (102, "Interjection: the hill clans bree​d like rats and steal whatever is not nailed down.")]
    empty = [(200, None), (201, ""), (202, "   "), (203, "7 8 9"), (204, "word " * 30_000), (None, "Sit down"), (None, None)]
    df = spark.createDataFrame(docs + toxic + empty + docs[:1], "id int, text string").selectExpr("*", "'x' as _scored", "1 as score", "2 as key")
    rows = score_texts(df, "text", "id", labels_of(spark, LABELS * 5)).collect()
    assert len(rows) == df.count()
    found = {r.id for r in rows if r.score is not None and r.score >= THRESHOLD}
    assert found == {100, 101, 102}
    assert [r.score for r in rows if r.id == 200] == [None]
    assert [r.score for r in rows if r.id in (201, 202, 203)] == [0.0, 0.0, 0.0]
    assert score_texts(df.limit(0), "text", "id", labels_of(spark, LABELS)).count() == 0
    assert {r.score for r in score_texts(df.where("id < 3"), "text", "id", labels_of(spark, [])).collect()} == {0.0}


def test_learns_unlabelled_expressions_from_the_places_they_share(spark):
    """Labelled insults stand in the flow and after colons alike, unlabelled ones too; ordinary remarks after colons only, procedure in the flow only."""
    rng = random.Random(2)
    insults = ["You are nothing but a rotten rat", "Shut your mouth, you moron", "May wolves gnaw upon thy bones tonight", "A pox take thee and thy stinking kin"]
    remarks = ["Hear the honourable member out", "That claim is simply untrue", "Wait until autumn for that ledger"]
    things = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(120)]
    frames = ["The board noted the {} without debate", "Payment for the {} was made to the harbour office", "The clerk read the {} aloud", "We adjourned with {} for lunch"]
    plain = [f.format(x) for f in frames for x in things]
    docs, guilty = [], set()
    for i in range(1500):
        parts = [rng.choice(plain) for _ in range(4)]
        if i % 12 == 0:
            guilty.add(i)
            insult = rng.choice(insults)
            parts.insert(2, insult if rng.random() < 0.5 else f"A voice: {insult}")
        elif i % 4 == 0:
            parts.insert(2, f"A voice: {rng.choice(remarks)}")
        docs.append((i, ". ".join(parts) + "."))
    labels = [(f"{rng.choice(plain)}. {x}!", "abusive") for x in insults[:2] for _ in range(6)] + [(p + ".", "clean") for p in plain[::7]] + [(r + ".", "clean") for r in remarks[:2]]
    rows = score_texts(spark.createDataFrame(docs, "id int, text string"), "text", "id", labels_of(spark, labels)).collect()
    assert {r.id for r in rows if r.score >= THRESHOLD} == guilty


def test_held_out_labels(spark, sf):
    """Two thirds of the labels and the corpus find the toxic rows of the last third."""
    folder = f"{os.path.dirname(sf)}/sf0.1"
    rows = [(r.text, r.category) for r in spark.read.parquet(f"{folder}/abuse_labels.parquet").where("text is not null").orderBy("example_id").collect()]
    random.Random(0).shuffle(rows)
    table = clause_table(read_corpus(spark.read.parquet(f"{folder}/documents.parquet").repartition(4), "text", "doc_id"))
    hits = misses = false = 0
    for fold in range(3):
        scorer = Scorer(fit_models(labels_of(spark, [r for i, r in enumerate(rows) if i % 3 != fold]), table))
        for text, category in rows[fold::3]:
            toxic = scorer.text(text) >= THRESHOLD
            hits += toxic and category != "clean"
            misses += not toxic and category != "clean"
            false += toxic and category == "clean"
    print("held out:", hits, misses, false)
    assert hits / (hits + misses) >= 0.9
    assert hits / (hits + false) >= 0.9


def test_misspelling_does_not_stand_for_the_right_word(spark, sf):
    """sf0.1 holds "quieily rewrote" in toxic company twice, which says nothing about "quietly rewrote", said 2,877 times."""
    folder = f"{os.path.dirname(sf)}/sf0.1"
    table = clause_table(read_corpus(spark.read.parquet(f"{folder}/documents.parquet").repartition(4), "text", "doc_id"))
    scorer = Scorer(fit_models(spark.read.parquet(f"{folder}/abuse_labels.parquet"), table))
    assert scorer.text("Once again the auditor quietly rewrote the timetable of dog breeding licences.") < THRESHOLD
    assert scorer.text("The government quietly rewrote the second annex of the report.") < THRESHOLD
    assert scorer.text("Shut your mouth, you m0ron") >= THRESHOLD


def test_every_label_counts(spark):
    """The only toxic labels come after 20,000 clean ones."""
    labels = [("The report runs to 5 pages. I thank the staff.", "clean")] * 20_000 + LABELS * 5
    rows = [(i, "The report runs to 9 pages. I thank the staff of the board for their work.") for i in range(60)] + [(100, "Shut your mouth, you moron")]
    found = score_texts(spark.createDataFrame(rows, "id int, text string"), "text", "id", labels_of(spark, labels)).where(f"score >= {THRESHOLD}").collect()
    assert [r.id for r in found] == [100]


def test_learned_trigrams_are_joined_where_they_lie(spark):
    learned = ["a b c", "b c d", "x y z", "y z w", "<s> q </s>", "l l l", "m b a", "a b d"]
    rows = spark.createDataFrame([(g, 3, 1, 0) for g in learned], "gram string, n bigint, k bigint, q bigint")
    grams = lambda toxic, words: {r.gram for r in joined(rows, toxic, words).collect()}
    assert grams(set(), {"d"}) == {"a b c", "b c d"}
    assert grams({("z", "w", "v")}, {"q", "w", "l"}) == {"<s> q </s>", "y z w", "x y z"}
    assert grams({("b", "a", "x")}, {"m"}) == {"m b a"} and grams(set(), set()) == set()
