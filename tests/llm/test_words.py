import random

import numpy as np

from edgeline.llm.common import Words


def test_words_belong_to_their_texts():
    rng = random.Random(4)
    for _ in range(50):
        texts = ["".join(rng.choices("ab \n", k=rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 8))]
        w = Words(texts)
        counts = [len(t.split()) for t in texts]
        assert w.counts.tolist() == counts
        assert w.first.tolist() == [sum(counts[:i]) for i in range(len(texts) + 1)]
        assert w.doc.tolist() == [i for i, c in enumerate(counts) for _ in range(c)]
        assert {x.dtype for x in (w.counts, w.first, w.doc)} == {np.dtype(np.int64)}
