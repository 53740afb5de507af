"""Main text of pages that don't name their article."""

import re

import pytest

from rivulet.llm.html import main_text

EN = ["The ship was late, and none of the men at the gate had heard of it in the night before that day, as they said.", "It is not for us to say what she will do with all of that in the years to come, but he knows it."]
DE = ["Das Schiff war nicht da, und keiner von uns hat es in der Nacht vor dem Tag gesehen, wie sie es mit ihm sagen.", "Es ist nicht an uns, das zu sagen, was sie mit der Zeit und dem Geld noch für ihn tun wird, wenn er es so will."]
FR = ["Le bateau est en retard, et je ne sais pas par qui il est parti dans la nuit, avec les autres ou sur le pont.", "Il n'est pas pour nous de dire ce que la ville et son maire ont fait pour les gens qui sont dans le port."]
ES = ["El barco no es de la ciudad, y no hay una persona que lo sepa en la noche, con su familia o sin ella, por eso.", "No es para que se diga lo que la gente del puerto ya sabe de los barcos y de su historia en el mar del sur."]
PL = ["Statek przypłynął dzisiaj wieczorem, kiedy miasto spało; nikt prócz strażnika, dwóch rybaków, jednego chłopca tego widzieć nie mógł. Latarnia zgasła."] * 2
NAV = "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>"
LINKS = "<div><a href=/1>One more story</a> <a href=/2>Another story of the day</a> <a href=/3>And all the rest of it</a></div>"
FOOT = "<footer>&copy; 2024 by the people of the site. All that is here is theirs.</footer>"
CODE = "for i in range(10):\n    total += table[i]\n    print(total, i)\nresult = compute(total, table)  # checksum"


def page(body, top=NAV, end=FOOT):
    return f"<html><head><title>T</title></head><body>{top}<div>{body}</div>{end}</body></html>"


@pytest.mark.parametrize("text", [EN, DE, FR, ES, PL])
@pytest.mark.parametrize("top", ["", NAV, NAV + LINKS])
def test_short_paragraphs(text, top):
    assert main_text(page("".join(f"<p>{p}</p>" for p in text), top)) == "\n\n".join(text)
    assert main_text(page(f"<p>{text[0]}</p>", top)) == text[0]


def test_code_and_lists_between():
    flat = re.sub(r"\s+", " ", CODE)
    assert main_text(page(f"<p>{EN[0]}</p><pre>{CODE}</pre><p>{EN[1]}</p>")) == f"{EN[0]}\n\n{flat}\n\n{EN[1]}"
    ten = "".join(f"<p>{p}</p>" for p in EN * 5)
    assert main_text(page(f"{ten}<pre>{CODE}</pre>{ten}")).count("\n\n") == 20
    assert main_text(page(f"<p>{EN[0]}</p><ul><li>red wool<li>blue wool</ul><p>{EN[1]}</p>")) == f"{EN[0]}\n\nred wool\n\nblue wool\n\n{EN[1]}"
    assert main_text(page(f"<h1>The log</h1><pre>{CODE}</pre>")) == f"The log\n\n{flat}"


def test_headings_and_short_ends():
    assert main_text(page(f"<h1>Late again</h1><p>{EN[0]}</p><h2>Why</h2><p>{EN[1]}</p><p>So it goes.</p>")) == f"Late again\n\n{EN[0]}\n\nWhy\n\n{EN[1]}\n\nSo it goes."
    assert main_text(page("<h1>Note</h1><p>We are closed.</p>")) == "Note\n\nWe are closed."
    assert main_text(page("")) == main_text(page(LINKS)) == ""


def test_formulas_are_text():
    body = "<p>It is shown that <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='application/x-tex'>E=m</annotation></math> holds for all of the bodies that we have.</p>"
    assert main_text(page(body)) == "It is shown that E=m holds for all of the bodies that we have."


def test_pages_without_their_wrappers(spark):
    """Of the given pages those whose article and main are plain divs have the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    same = sum(main_text(h) == main_text(re.sub(r"<(/?)(article|main)\b[^>]*>", r"<\1div>", h)) for h in pages)
    assert len(pages) >= 200 and same >= 0.99 * len(pages)
