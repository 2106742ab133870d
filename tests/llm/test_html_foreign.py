"""Text below svg, math and object."""

import pytest

from voxelore.llm.html_text import visible_text


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then", "if x=2 then"),
        ("<math><semantics><mi>y</mi><annotation encoding='application/x-tex'>\\\\y</annotation><annotation-xml><ci>z</ci></annotation-xml></semantics></math>", "y"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math>", "1 2\n3 4"),
        ("a<svg><title>t</title><desc>d</desc><metadata>m</metadata><defs><text>u</text></defs><rect width='1'/><text x='1'>North</text><text>South</text></svg>b", "a\nNorth\nSouth\nb"),
        ("<svg><defs/><title/><text>left</text></svg>", "left"),
        ("<svg><style>.n{display:none}</style><text class=n>no</text><text>yes</text></svg>", "yes"),
        ("<object data='x.swf'><param name=a value=b>no <b>player</b></object>", "no player"),
        ("<desc>a</desc> <defs>b</defs>", "a b"),
    ],
)
def test_foreign_text(markup, text):
    assert visible_text(markup) == text
