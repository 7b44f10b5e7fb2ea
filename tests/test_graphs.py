"""Dominators and orders of known graphs; children in the listed order."""

import pytest

from bytelens.operators.cfg import dominators, postorder

GRAPHS = {
    "loops": ("r→a,b,c; a→d; b→a,d,e; c→f,g; d→l; e→h; f→i; g→i,j; h→e,k; i→k; j→i; k→i,r; l→h", "r:- a:r b:r c:r d:r e:r f:c g:c h:r i:r j:g k:r l:d", "r:1 a:7 b:6 c:2 d:8 e:13 f:5 g:3 h:10 i:12 j:4 k:11 l:9"),
    "two cycles": ("r→y1,x12; y1→y2,x11; y2→x21; x11→x12,x22; x12→x11; x21→x22; x22→x21", "r:- y1:r y2:y1 x11:r x12:r x21:r x22:r", "r:1 x11:3 x12:4 x21:6 x22:7 y1:2 y2:5"),
    "cross": ("r→a,d; a→b; b→c; c→a,d,g; d→e; e→f; f→a,d,g", "r:- a:r b:a c:b d:r e:d f:e g:r", "r:1 a:2 b:3 c:4 d:5 e:6 f:7 g:8"),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_known_graph(name):
    text, idom, rpo = GRAPHS[name]
    succ = {a: b.split(",") for a, b in (x.split("→") for x in text.split("; "))}
    want = {a: None if b == "-" else b for a, b in (x.split(":") for x in idom.split())}
    assert dominators(succ, "r") == want
    order = postorder(succ, "r")[::-1]
    assert {n: i + 1 for i, n in enumerate(order)} == {a: int(b) for a, b in (x.split(":") for x in rpo.split())}
