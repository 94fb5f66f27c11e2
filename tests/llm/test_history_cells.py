import random

import pytest

from lodestrata.llm import history
from lodestrata.llm.history import History
from lodestrata.tables import scratch_path

WORDS = [f"{a}{b}" for a in ("gar", "mol", "tes", "vin", "ker", "pad") for b in ("den", "top", "ver", "nal", "fis")]


@pytest.mark.parametrize("seed", range(3))
def test_short_texts_with_several_edits_are_found(spark, seed):
    """Every pair near by phrases and by word pairs, however few longer runs of words are left."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        words = [f"{rng.choice(WORDS)}{i}" for _ in range(45)]
        edited = list(words)
        for at in range(7, 45, 15):
            edited[at] = f"edit{at}x{i}"
        rows += [(2 * i + 1, " ".join(words)), (2 * i + 2, " ".join(edited))]
    df = spark.createDataFrame(rows, "id long, content string")
    bits, hashes = history.rarity(history.vectors(df)), history.WordHashes()
    copies = {i + 1 for (i, a), (_, b) in zip(rows[::2], rows[1::2]) if history._similar(a, b) and history._near(a, b, bits, hashes)}
    assert len(copies) >= 30
    got = {r.id: r.class_id for r in History(spark, scratch_path(spark, "t")).admit(df).collect()}
    assert got == {i: i - 1 if i in copies else i for i, _ in rows}
