import random

from lodestrata.llm.linking import link_names, pairs_of
from lodestrata.llm.names import Name, blocks, read_name, same_name


def slip(word, rng):
    i, c = rng.randrange(len(word)), rng.choice("abdeklmnorst")
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]))


def test_a_slip_in_each_part_is_linked(spark):
    names = ["Vlqdimir Kanokukru", "Vladimir Kanoukkru", "Elena Grimholt"]
    a, b, _ = map(read_name, names)
    assert same_name(a, b) and blocks(a) & blocks(b)
    df = spark.createDataFrame([(i, n, "person") for i, n in enumerate(names, 1)], "id long, name string, entity_type string")
    assert [(r.id_a, r.id_b) for r in pairs_of(link_names(df)).collect()] == [(1, 2)]


def test_whatever_is_accepted_shares_a_block():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abdeklmnorst") for _ in range(rng.randrange(4, 12)))
    seen = 0
    for _ in range(30_000):
        p, q = rng.choice((word(), "vladimir", "johannes", "bob")), word()
        r, s = (slip(x, rng) if rng.random() < 0.6 else x for x in (p, q))
        for _ in range(rng.randrange(2)):
            s = slip(s, rng)
        a, b = (Name("person", tuple(sorted((p, q)))), Name("person", tuple(sorted((r, s)))))
        if rng.random() < 0.3:
            a, b = Name("firm", ("bank", p + " " + q)), Name("firm", ("bank", r + " " + s))
        if min(map(len, (*a.parts, *b.parts))) > 1 and same_name(a, b):
            seen += 1
            assert blocks(a) & blocks(b), (a, b)
    assert seen > 10_000


def test_accepted_names_differ_by_few_letters():
    import random

    from lodestrata.llm.names import imaged_blocks, read_name, same_name

    rng = random.Random(7)
    base = ["Vladimir Kanoukkru", "Maria Hoelderlin", "Liz Muellerova", "Bob Whitechapel", "Kate Duerrenmatt", "Krupor Logistics GmbH", "M. Hoelderlin"]

    def slip(t):
        k = rng.randrange(1, len(t) - 1)
        c = rng.choice("abcdefghijklmnopqrstuvwxyz")
        return rng.choice([t[:k] + t[k + 1 :], t[:k] + c + t[k:], t[:k] + c + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :]])

    met = 0
    for _ in range(4000):
        t = rng.choice(base)
        a, b = read_name(t), read_name(slip(slip(t)) if rng.random() < 0.6 else slip(t))
        if a != b and same_name(a, b):
            met += 1
            pairs = [(x, y) for p, x in imaged_blocks(a) for q, y in imaged_blocks(b) if p == q]
            assert any((x & ~y).bit_count() <= 2 and (y & ~x).bit_count() <= 2 for x, y in pairs), (a, b)
    assert met > 300
