"""A page whose head has no end tag."""

import pytest

from strataweave.llm import html

STORY = "<article><h1>A</h1><p>To be, or not.</p></article>"


@pytest.mark.parametrize("head", ["<head><title>T</title>", '<head class="header"><meta charset="utf-8"><title>T</title><style>p{}</style>', "<head><title>T</title></head>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_head_without_end(head, body):
    assert html.main_text(f"<html>{head}{body}{STORY}", html.trained_tree()) == "A To be, or not."
