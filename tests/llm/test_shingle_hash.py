"""Words that a polynomial modulo 2^64 takes for one another."""

import numpy as np
import pytest

from seqtrail.llm import shingle_join


def thue_morse(letters, n):
    word = letters[0]
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_thue_morse_words_are_told_apart(spark):
    texts = {1: thue_morse("ab", 1024), 2: thue_morse("ba", 1024), 3: thue_morse("ab", 4096), 4: thue_morse("ba", 4096), 5: thue_morse("ab", 1024)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.components(frame).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_hash_depends_on_the_word_alone(chunk):
    words = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefgha", "hgfedcba", "aaaaaaaaaaaaaaaa", "a" * 17, "ü", "日本語日本語", "x" * 500, "x" * 499 + "y"]
    words += ["abcdefgh" + "ijklmnop", "ijklmnop" + "abcdefgh"]
    text = " ".join(words) + "\n" + "\t".join(reversed(words)) + " "
    starts, hashes = shingle_join.hash_words(np.frombuffer(text.encode(), np.uint8), chunk)
    assert len(starts) == 2 * len(words) and len(set(hashes[: len(words)].tolist())) == len(words)
    assert hashes[: len(words)].tolist() == hashes[len(words) :][::-1].tolist()
