from careflow.llm.divergence import COMMON_WORDS, divergence_rules, duplicate_lines, repeated_words


def test_repeated_words_counts_the_words_of_repeated_windows():
    words = "a b c d e x a b c d e".split()
    assert repeated_words(words) == 10
    assert repeated_words(list("aaaaaa")) == 6
    assert repeated_words(list("abcd")) == 0
    assert repeated_words([]) == 0


def test_duplicate_lines_ignore_blank_ones():
    assert duplicate_lines("a\nb\na\n\n \n \na") == 2
    assert duplicate_lines("") == 0


def test_odd_texts_equal_sql(docs, against_sql):
    clean = " ".join(COMMON_WORDS["en"] * 4) + " quiet harbour stones were counted slowly by nobody important."
    tables = docs(
        None, "", " \n\t ", "one", clean, clean, "$$$ ### || " * 80, "É ß İ " * 30, "\U0001f600 " * 200,
        " ".join(f"w{i}" for i in range(30_000)), (77, clean), ("the of and " * 40).strip(),
    )
    against_sql("op1_distribution_divergence", lambda documents: divergence_rules(documents), documents=tables)


def test_languages_without_words_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string"
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 6
    mixed = [(i, f"{text} {i} " + " ".join(f"x{i}y{j}" for j in range(40)), lang) for i, lang in enumerate(["xx", None, "en", "zz"] * 3)]
    out = divergence_rules(spark.createDataFrame(mixed, schema))
    assert out.count() == 12 and out.where("word_distance is not null and doc_id % 4 <> 2").count() == 0
    assert divergence_rules(spark.createDataFrame([], schema)).count() == 0


def test_junk_is_rejected_and_repeated_rows_agree(spark):
    import random

    rng = random.Random(5)
    words = COMMON_WORDS["en"] + [f"{a}{b}ing" for a in "bcdfg" for b in ("al", "or", "en", "um")]

    def prose():
        return " ".join(rng.choice(words) for _ in range(150)).capitalize() + "."

    good = [(i, prose(), "en") for i in range(40)]
    bad = [(100, " | ".join(w.upper() + "$$" for w in prose().split()), "en")]
    out = {(r.doc_id, r.kept) for r in divergence_rules(spark.createDataFrame(good + good[:1] + bad, "doc_id long, text string, lang string")).collect()}
    assert (100, False) in out and (0, True) in out and (0, False) not in out
    assert sum(kept for _, kept in out) >= 38
