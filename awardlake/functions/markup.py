"""HTML as a flat list of events, shared by everything that reads markup.

A document is read to its end: text after the last tag, half entities and open tags included.
"""

import sys
from html.parser import HTMLParser

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, CLOSE, TEXT = range(3)
UNSEEN = frozenset(("script", "style"))


class _Recorder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.log = []

    def handle_starttag(self, tag, attrs):
        self.log.append((OPEN, tag, attrs))

    def handle_endtag(self, tag):
        self.log.append((CLOSE, tag, None))

    def handle_data(self, data):
        self.log.append((TEXT, None, data))


def events(html):
    """(OPEN, tag, attributes), (CLOSE, tag, None) and (TEXT, None, text) in document order."""
    recorder = _Recorder()
    try:
        recorder.feed(html or "")
        recorder.close()
    except (AssertionError, ValueError):  # declarations that the tokenizer gives up on: what was read counts
        pass
    return recorder.log


def visible(log):
    """Texts of a list of events that are neither blank nor inside script and style."""
    inside = None
    for kind, tag, value in log:
        if kind == TEXT:
            if inside is None and value.strip():
                yield value
        elif tag in UNSEEN:
            inside = tag if kind == OPEN else None


def attribute(log, tag, name):
    """Non-empty values of one attribute of all such tags."""
    for kind, found, attributes in log:
        if kind == OPEN and found == tag:
            value = next((v for n, v in attributes if n == name), None)
            if value:
                yield value.strip()


def outermost(log, tag):
    """(start, end) of the events inside each outermost element that is closed."""
    depth = start = 0
    for at, (kind, found, _) in enumerate(log):
        if found != tag or kind == TEXT:
            continue
        if kind == OPEN:
            start = at + 1 if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield start, at
