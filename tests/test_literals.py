"""Every phrase pattern needs one of its group's literals: matches are made from the patterns and searched for them."""

import random
import re

from wardline.functions import lexicon as lx
from wardline.functions.features import LITERALS

try:
    from re import _parser as parser
except ImportError:
    import sre_parse as parser


def example(tree, rng):
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[0]
            out += " " if str(kind) == "CATEGORY" else chr(value) if str(kind) == "LITERAL" else chr(value[0])
        elif name == "MAX_REPEAT":
            low, _, sub = arg
            for _ in range(low + (rng.random() < 0.5 if low == 0 else 0)):
                out += example(sub, rng)
        elif name == "SUBPATTERN":
            out += example(arg[3], rng)
        elif name == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        elif name != "AT":
            raise AssertionError(name)
    return out


def test_literals_are_necessary():
    rng = random.Random(1)
    for group, phrases in lx.PHRASES.items():
        for phrase in phrases:
            for _ in range(400):
                text = example(parser.parse(phrase), rng)
                assert re.search(phrase, text, re.I), (phrase, text)
                assert any(w in text for w in LITERALS[group].split()), (phrase, text)
