from specaudit.operators import consistency as C

SAME = [  # one thing under several names
    ("notice period length", "length of notice period"), ("governing law state", "state governing law"), ("assignment consent needed", "consent needed for assignment"),
    ("audit rights scope", "scope of audit rights"), ("renewal term months", "months of renewal term"), ("payment due days", "days payment due"),
    ("liability cap amount", "amount of liability cap"), ("insurance cover level", "level of insurance cover"), ("data return duty", "duty of data return"),
]
DIFFERENT = [  # alike but for a word that sets them apart
    ("lease term start", "initial lease term start"), ("rent review date", "current rent review date"), ("loan interest rate", "default loan interest rate"),
    ("exit fee amount", "maximum exit fee amount"), ("price list version", "prior price list version"),
]


def test_grades_agree_with_labelled_names(spark):
    rows, labels = [], []
    for matter, (names, label) in enumerate([*((n, "same") for n in SAME), *((n, "different") for n in DIFFERENT)], 1):
        rows += [(matter, 10 * matter + k, name, None, "extraction") for k, name in enumerate(names)]
        labels.append((matter, min(names), label))
    described = spark.createDataFrame(rows, "matter_id long, table_id long, name_key string, concept string, role string")
    links = C.similar_name_links(C.candidate_names(described))
    graded = C.name_cluster_confidence(C.name_clusters(links), links, described)
    got = C.heuristic_precision(graded, spark.createDataFrame(labels, "matter_id long, cluster string, label string")).first()
    assert graded.count() == len(labels)
    assert got.strong_precision >= 0.90 and got.possible_precision >= 0.80 and got.graded_correctly >= 0.85
