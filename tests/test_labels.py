"""Hand-written edge rows for label expressions."""

import hashlib

import pytest

from palaver.fixed import EMOTIONS
from palaver.functions import labels as L


def test_decode_and_encode(one):
    assert one(L.decode, "", "joy", "joy|anger", "|joy|") == [
        [],
        ["joy"],
        ["joy", "anger"],
        ["joy"],
    ]
    assert one(L.encode, ["joy", "anger"], [], kind="array<string>") == ["joy|anger", ""]


def test_sentiment(one):
    sets = [["joy", "anger"], ["surprise"], ["surprise", "joy"], [], ["weird"], ["neutral"]]
    assert one(L.sentiment_of, *sets, kind="array<string>") == [
        "negative",
        "neutral",
        "positive",
        "neutral",
        "neutral",
        "neutral",
    ]


def test_groups(one):
    assert one(L.group_of, "joy", "fear", "surprise", "neutral", "weird") == [
        "positive",
        "negative",
        "neutral",
        "neutral",
        "unmapped",
    ]


def test_indices_and_names(one):
    assert one(L.names_of, [0, 27], [], kind="array<int>") == [["admiration", "neutral"], []]
    assert one(L.indices_of, ["neutral", "weird", "anger"], kind="array<string>") == [[27, 2]]


def test_threshold_is_inclusive(one):
    scores = [0.0] * len(EMOTIONS)
    scores[2], scores[17], scores[18] = 0.5, 0.4999, 0.9
    assert one(L.above_threshold, scores, kind="array<double>") == [["anger", "love"]]


def test_replies(one):
    cases = {
        '{"emotions": ["Joy ","x","joy"]}': ["joy"],
        '{"labels":"anger"}': ["anger"],
        'ok: {"emotions": ["fear"]} end': ["fear"],
        "I feel joy, and anger": ["anger", "joy"],
        '["love"]': ["love"],
        '{"emotions": []}': [],
        "null": [],
        '{"emotions": ["x"], "note": "joy"}': [],
        '{"emotions": null, "labels": ["joy"]}': ["joy"],
        '{"emotions": 5, "text": "grief"}': ["grief"],
        '"joy"': ["joy"],
        " [\"Pride\", 3, null] \n": ["pride"],
        'bad {"emotions": [joy} but anger': ["anger", "joy"],
        "enjoyment, joyful": [],
        "": [],
    }
    assert one(L.parse_reply, *cases) == list(cases.values())


def test_replies_with_repeated_keys(one):
    cases = {
        '{"emotions": ["joy"], "emotions": ["fear"]}': ["fear"],
        '{"emotions": ["joy"], "labels": ["love"], "emotions": []}': ["joy", "love"],
        '{"labels": "joy", "labels": "love"}': ["love"],
        '{"labels": "joy", "a": {"labels": "fear", "labels": "grief"}}': ["joy"],
        '{"a": 1, "a": {"emotions": ["grief"]}, "emotions" : ["pride"]}': ["pride"],
        '{"emotions": "anger", "n": "\\"emotions\\": [", "emotions": ["x", "joy"]}': ["joy"],
        'so {"emotions": ["joy"], "emotions": "love"} end': ["love"],
        '[{"a": 1, "a": 2}, "joy"]': ["joy"],
        # Repeated, but no JSON: searched as text.
        '{"emotions": ["joy"], "emotions": ["fear"]': ["fear", "joy"],
        '{"emotions": ["joy"], "emotions": ["fear"] "x"}': ["fear", "joy"],
        '{"emotions": ["joy"], "emotions": ["fear", ]}': ["fear", "joy"],
        '{"emotions": ["joy"], "emotions": ["fear"]} "': ["fear"],
        None: None,
    }
    assert one(L.parse_reply, *cases) == list(cases.values())


def test_negative_and_large_indices_raise(one):
    for bad in ([-2], [0, -1], [28]):
        with pytest.raises(Exception, match="index"):
            one(L.names_of, bad, kind="array<int>")
    assert one(L.names_of, [3, None], kind="array<int>") == [["annoyance", None]]


def test_prompt_and_digest(one):
    text = "café"
    assert one(L.digest, text) == [hashlib.sha256(text.encode()).hexdigest()]
    (prompt,) = one(L.prompt, text)
    assert prompt.endswith("Comment: café") and ", ".join(EMOTIONS) in prompt
