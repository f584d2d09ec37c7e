"""Deterministic stand-ins for models, small enough to restate in SQL."""

from __future__ import annotations

import string

from palaver.fixed import EMOTIONS

# One character per label; a label's score grows with its character's frequency.
CHARACTERS = (string.ascii_lowercase + string.digits)[: len(EMOTIONS)]
GAIN = 8


def letter_scores():
    """Scores of the 28 labels: eight times a character's share of the text, at most 1."""

    def predict(texts: list[str]) -> list[list[float]]:
        return [
            [min(1.0, GAIN * text.count(c) / max(len(text), 1)) for c in CHARACTERS]
            for text in texts
        ]

    return predict


def parity_replies():
    """Answers joy to prompts of even length and anger to others."""

    def reply(prompts: list[str]) -> list[str]:
        return [
            '{"emotions": ["%s"]}' % ("joy" if len(prompt) % 2 == 0 else "anger")
            for prompt in prompts
        ]

    return reply
