"""Pages made to be slow, and the tags that are left unfinished."""

import time

import pytest

from voxelore.llm.html_text import visible_text


@pytest.mark.parametrize("part", ["<a ", "<a", "<a '", '<a "', "<a '\"", "</a ", "<!--", "<!", "<style>", "</style ", "<a b=", "<p title='>", "/*", "{", "&lt"])
@pytest.mark.parametrize("head", ["", "<style>", "<p>"])
@pytest.mark.parametrize("tail", ["", ">", "'\"x"])
def test_time_is_in_proportion(part, head, tail):
    began = time.process_time()
    visible_text(head + part * 40_000 + tail)
    assert time.process_time() - began < 4


@pytest.mark.parametrize(
    "markup, text",
    [
        ("a <b c", "a <b c"),
        ("a<p title='x>b</p><p>c</p>", "a<p title='x>b\n\nc"),
        ("a <b title='>'>c</b> 1 < 2 <3 </ d", "a c 1 < 2 <3 </ d"),
        ("<!-- a -- > b --> c <!d> e <?f> g <!-- h", "c e g"),
        ("<style>p{display:none}/* open p{display:block}</style><p>a</p>b", "b"),
        ("<style>x{y} p , q { display : none } z</style><p>a</p><q>b</q>c", "c"),
    ],
)
def test_unfinished(markup, text):
    assert visible_text(markup) == text
