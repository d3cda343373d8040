from __future__ import annotations

import inspect
import zlib

from plurality.llm import toxicity


def test_words_have_their_five_grams():
    assert {zlib.crc32(part) % toxicity.BUCKETS for part in (b"<abom", b"omina", b"able>")} <= set(toxicity.subwords("abominable"))


def test_training_takes_six_thousand_of_a_class():
    assert inspect.signature(toxicity.train).parameters["most"].default == 6000
