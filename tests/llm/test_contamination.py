from careflow.llm.contamination import contamination, without_contaminated

ITEM = "The quick brown fox jumps over the lazy dog near the old river bank"


def items(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_items string")


def both(most_bytes):
    return lambda documents, benchmark: contamination(documents, benchmark, most_bytes=most_bytes)


def test_odd_rows_equal_sql_through_both_joins(spark, docs, against_sql):
    tables = docs(
        None, "", "...", ITEM.upper() + "!", "x " + ITEM + " y " + ITEM, " ".join(ITEM.split()[:9]), "quick, Brown", "ÉLAN élan",
        ("word " * 30_000) + ITEM, ITEM.replace(" ", "--"), (99, None),
    )
    benchmark = items(
        spark, (1, ITEM), (2, ITEM), (11, None), (3, ""), (4, "brown"), (5, "quick brown"), (6, "ÉLAN"), (7, "word " * 12),
        (8, ITEM + " and then some more words follow after it"),
    )
    for most in (None, 0):
        against_sql("op2_prefix_decontamination", both(most), documents=tables, benchmark=benchmark)


def test_repeated_rows_nulls_and_empty_tables(spark, docs):
    benchmark = items(spark, (1, ITEM), (None, ITEM))
    got = [tuple(r)[:4] for r in contamination(docs((7, ITEM), (7, ITEM), (7, "clean"), (None, ITEM)), benchmark).collect()]
    assert sorted(got, key=str) == sorted([(7, 14, 14, 2), (7, 14, 14, 2), (7, 1, 0, 0), (None, 14, 14, 2)], key=str)
    assert contamination(docs(ITEM), benchmark.limit(0)).first().contaminated is False
    assert contamination(docs(ITEM).limit(0), benchmark).count() == 0


def test_clean_rows_stay_whole(spark, docs):
    table = docs(ITEM, "nothing of it", None, (None, "x"), (None, ITEM))
    kept = without_contaminated(table, items(spark, (1, ITEM)))
    assert kept.columns == table.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(1, "nothing of it"), (2, None)]
    assert kept.count() == 3
