"""Reading JSON that a model has written: with a fence or talk around it, cut off, or with slips of notation."""

from __future__ import annotations

import json

_CONSTANTS = {"true": True, "false": False, "null": None, "none": None, "nan": None}


class _Reader:
    """A lenient reader: quotes of either kind, names without quotes, commas too many or too few, missing ends."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self, also: str = "") -> str:
        while self.at < len(self.text) and (self.text[self.at].isspace() or self.text[self.at] in also):
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.skip()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in ('"', "'", "“"):
            return self.string("”" if c == "“" else c)
        return self.bare()

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while (c := self.skip(",;")) and c != "}":
            if c == "]":  # an end that was left out
                return out
            name = self.string("”" if c == "“" else c) if c in ('"', "'", "“") else self.bare(":")
            if self.skip() == ":":
                self.at += 1
                out[str(name)] = self.value() if self.skip() not in (",", "}", "") else None
            elif self.at >= len(self.text):
                break
        self.at += 1
        return out

    def array(self) -> list:
        self.at += 1
        out: list = []
        while (c := self.skip(",;")) and c != "]":
            if c == "}":
                return out
            out.append(self.value())
        self.at += 1
        return out

    def string(self, end: str) -> str:
        start = self.at = self.at + 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.at += 2
                continue
            if c == end and (self.at + 1 == len(self.text) or self.text[self.at + 1 :].lstrip()[:1] in (",", ":", "}", "]", "")):
                break  # a quote that something else follows is a part of the text
            self.at += 1
        body = self.text[start : self.at]
        self.at += 1
        try:
            return json.loads('"' + body.replace("\\'", "'").replace('\\"', '"').replace('"', '\\"') + '"', strict=False)
        except ValueError:
            return body

    def bare(self, ends: str = ""):
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ",}]\n" + ends:
            self.at += 1
        if self.at == start:
            self.at += 1
        word = self.text[start : self.at].strip()
        if word.lower() in _CONSTANTS:
            return _CONSTANTS[word.lower()]
        try:
            return json.loads(word)
        except ValueError:
            return word


def read_json(text: str):
    """The first object or list in a text, repaired if need be. ValueError if there is none."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        raise ValueError("no JSON in the text")
    try:
        return json.JSONDecoder().raw_decode(text, start)[0]
    except ValueError:
        reader = _Reader(text)
        reader.at = start
        return reader.value()
