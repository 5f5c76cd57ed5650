import random
import re

from helpers import documents, prose

from specaudit.llm import decontamination as D

ITEM = "Yes Tom has 5 apples and gives 3 km of rope to Anna, then Tom walks home with 5 apples."
DOCS = [
    (1, f"some text before it. {ITEM} And some after."),
    (2, "Now so Bob has 7 apples and gives 9 miles of rope to Eve, then Bob walks home with 7 apples."),
    (3, "Now so Bob has 7 apples and gives 9 miles of rope to Eve, then Zed walks home with 8 apples."),
    (4, None), (None, ""), (5, "7 8 9 10 11 12 13 14 15 16 17 18"), (6, "has apples"), (None, f"x {ITEM}"),
    (7, "filler " * 40_000 + ITEM), (1, "the same id without the item"), (8, ITEM + " " + ITEM), (8, ITEM + " " + ITEM),
]
ITEMS = [(1, ITEM), (2, None), (None, "too short"), (3, ""), (4, "1 2 3 4 5 6 7 8 9 10")]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_reparameterised_items_are_found_and_inconsistent_ones_are_not(spark):
    got = {(r.doc_id, r.item_id): r.verbatim for r in D.leaks(documents(spark, DOCS), items(spark, ITEMS)).collect()}
    assert got == {(1, 1): True, (2, 1): False, (None, 1): True, (7, 1): True, (8, 1): True}


SLIPS = [
    (1, ITEM.replace("with 5", "with 6"), False),  # one of two equal numbers changed
    (2, ITEM.replace("then Tom", "then Tim"), False),  # one of two mentions of a name misspelt
    (3, ITEM, True),
    (4, ITEM.replace("Tom", "Bob").replace("has 5", "has 7").replace("with 5", "with 8"), False),  # renamed, with a slip
    (None, ITEM.replace("with 5", "with 6"), False),
]


def test_a_slip_costs_only_the_windows_around_it(spark):
    rows = [(i, t) for i, t, _ in SLIPS] + [DOCS[2]]
    docs = documents(spark, rows)
    got = {r.doc_id: (r.n_windows, r.item_windows, r.verbatim) for r in D.leaks(docs, items(spark, ITEMS[:1])).collect()}
    # The second number is in the last 2 of 13 windows, the second name in the last 6, of which one holds only it.
    assert got[1] == (11, 13, False) and got[2] == (7, 13, False) and got[3] == (13, 13, True) and got[None] == (11, 13, False)
    assert set(got) == {1, 2, 3, 4, None}
    assert [r.text for r in D.without_leaks(docs, items(spark, ITEMS[:1])).collect()] == [DOCS[2][1]]


def test_most_mentions_decide_which_windows_count(spark):
    item = "we met Al near the old mill and gave Al some bread and then Al went home with us"
    renamed = item.replace("Al", "Bo")
    slip = renamed[::-1].replace("oB", "yC", 1)[::-1]  # the last of three mentions
    every = item.replace("Al", "Bo", 1)[::-1].replace("lA", "yC", 1)[::-1].replace("Al", "Di")
    got = {r.doc_id: r.n_windows for r in D.leaks(documents(spark, [(1, renamed), (2, slip), (3, every)]), items(spark, [(1, item)])).collect()}
    assert got == {1: 12, 2: 7} and "Cy" in slip and "Di" in every


def test_plain_copies_are_found_whatever_their_templates(spark):
    names = "Ann Bob Cleo 4 Dan 5 Eve 6 Fay Gus met 7 Hal"  # one usable template at most
    short = "Rivers carry fine sand to Lyon"
    asked = items(spark, [(1, names), (2, short), (3, ITEM), (4, "1 2 3 4 5 6 7 8 9 10"), (5, "Élise où vont les étés passés à Évian")])
    rows = [
        (1, f"so {names} then"), (2, f"we read that {short} and more"), (3, ITEM.upper()), (4, f"x {short.upper()} y"), (5, "1 2 3 4 5 6 7 8 9 10"),
        (6, "ÉLISE OÙ VONT LES ÉTÉS PASSÉS À ÉVIAN"), (7, "Kim Lou Max 1 Ned 2 Oda 3 Pia Roy met 9 Sam"), (8, "11 12 13 14 15 16 17 18 19 20")]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.verbatim) for r in D.leaks(documents(spark, rows), asked).collect()}
    assert got == {(1, 1): (6, 6, True), (2, 2): (1, 1, True), (3, 3): (13, 13, True), (4, 2): (1, 1, True), (5, 4): (3, 3, True), (6, 5): (1, 1, True)}


def test_without_leaks_keeps_clean_rows_and_columns(spark):
    docs = documents(spark, DOCS)
    kept = D.without_leaks(docs, items(spark, ITEMS))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([DOCS[i] for i in (2, 3, 4, 5, 6, 9)], key=repr)


def test_empty_tables(spark):
    assert D.leaks(documents(spark, []), items(spark, ITEMS)).collect() == []
    assert D.leaks(documents(spark, DOCS), items(spark, [])).collect() == []


def test_words_get_their_placeholders():
    import pyarrow as pa

    def kinds(text):
        template, _, slot, _ = D.templates(pa.array([text]))
        names = {int(D.NUMBER): "#", int(D.UNIT): "u", int(D.NAME): "N"}
        return "".join(names.get(int(t), "w") if s else "w" for t, s in zip(template, slot))

    assert kinds("Anna saw Bob. He ran 5km in twelve minutes, or 3.5 h") == "wwNww#uw#uw#u"
    assert kinds("Élan vital d'Éa") == "wwwN"
    assert kinds("") == ""


def test_verbatim_windows_match_a_brute_force_search(spark):
    rng = random.Random(11)
    questions = [(i, prose(rng, rng.randint(5, 40))) for i in range(30)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words = rng.choice(questions)[1].split()
            cut = rng.randint(0, len(words) // 2)
            parts += [" ".join(words[cut:]), prose(rng, 5)]
        rows.append((i, " ".join(parts)))

    def windows(text, w):
        words = re.findall(r"\w+", text)
        return [tuple(words[k : k + w]) for k in range(len(words) - w + 1)]

    want = {}
    for d, text in rows:
        for q, item in questions:
            w = min(8, len(item.split()))
            own = windows(item, w)
            held = set(windows(text, w))
            covered = sum(x in held for x in own)
            if covered >= 0.5 * len(own) and covered:
                want[d, q] = covered
    got = {(r.doc_id, r.item_id): r.n_windows for r in D.leaks(documents(spark, rows), items(spark, questions)).collect()}
    assert got == want


def searched(rows, questions, width=8, least=5, share=0.5):
    """(doc, item) -> (windows that count, positions), straight from the definition, for words of plain letters and digits."""

    def read(text):
        out, before = [], None
        for m in re.finditer(r"[0-9]+|[A-Za-z]+", text):
            word, low = m[0], m[0].lower()
            opening = before is None or re.search(r"[.!?:\n]", text[before : m.start()])
            if low.isdigit() or low in D._NUMBERS:
                kind = "#"
            elif out and out[-1][1] == "#" and low in D._UNITS:
                kind = "u"
            else:
                kind = "N" if word[0].isupper() and not opening else ""
            out.append((low, kind))
            before = m.end()
        return out

    def windows(words, w):
        for at in range(len(words) - w + 1):
            part = words[at : at + w]
            yield at, tuple(x for x, _ in part), tuple(k or x for x, k in part), sum(bool(k) for _, k in part)

    found = {}
    for d, text in rows:
        words = read(text)
        for q, item in questions:
            asked = read(item)
            w = min(width, len(asked))
            if w < least:
                continue
            lines, count = {}, set()
            for a, plain, template, slots in windows(words, w):
                for b, plain_, template_, slots_ in windows(asked, w):
                    if plain == plain_:
                        count.add(b)
                    if template == template_ and slots == slots_ and 2 * slots <= w:
                        lines.setdefault(a - b, []).append((b, [(b + k, asked[b + k][0], words[a + k][0]) for k in range(w) if asked[b + k][1]]))
            for line in lines.values():
                spots = {x for _, filled in line for x in filled}
                for b, filled in line:
                    usual = all(2 * sum(y[1:] == (x, z) for y in spots) > sum(y[1] == x for y in spots) for _, x, z in filled)
                    if usual or all(x == z for _, x, z in filled):
                        count.add(b)
            if count and len(count) >= share * (len(asked) - w + 1):
                found[d, q] = len(count), len(asked) - w + 1
    return found


def test_templates_and_slots_match_a_brute_force_search(spark):
    rng = random.Random(5)
    plain, names, numbers, units = "river stone walks under green the with of".split(), "Ann Bob Cy Di".split(), "3 40 7 two".split(), "km hours".split()

    def sentence(n):
        words = []
        while len(words) < n:
            words += rng.choice([[rng.choice(plain)], [rng.choice(plain)], [rng.choice(names)], [rng.choice(numbers)], [rng.choice(numbers), rng.choice(units)]])
        return " ".join(words)

    def altered(text):
        kind = rng.randrange(5)
        if kind == 0:
            return text
        if kind == 1:
            return text.upper()
        if kind == 2:  # other numbers and names, the same everywhere
            swap = dict(zip(names, rng.sample(names, 4))) | dict(zip(numbers, rng.sample(numbers, 4)))
        words = text.split()
        if kind == 2:
            return " ".join(swap.get(x, x) for x in words)
        for _ in range(kind):  # slips
            at = rng.randrange(len(words))
            words[at] = rng.choice(numbers if words[at] in numbers else names if words[at] in names else plain)
        return " ".join(words)

    questions = [(i, sentence(rng.randint(3, 26))) for i in range(24)]
    rows = [(i, " ".join([sentence(rng.randint(0, 12)) + rng.choice(["", "."]), altered(rng.choice(questions)[1]), sentence(4)])) for i in range(90)]
    want = searched(rows, questions)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows) for r in D.leaks(documents(spark, rows), items(spark, questions)).collect()}
    assert got == want
    assert len(set(want.values())) >= 15  # many kinds of partial finds
