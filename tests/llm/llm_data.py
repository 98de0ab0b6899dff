"""Helpers of the tests in this folder."""

import random


def prose(seed: int, n: int, vocabulary: str = "the of river stone light over and green house walks slowly with many birds") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary.split()) + (r.choice(["", "", "", ",", ".", "\n"])) for _ in range(n))


def cells(df, key: str, *values: str) -> dict:
    return {str(r[key]): tuple(r[v] for v in values) for r in df.collect()}
