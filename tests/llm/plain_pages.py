"""Plain pages, written before the model was trained for them: short articles, no telling names, little or nothing around.
A block of main text begins with the sign §, which is taken out before use."""

P1 = "The old mill stopped in the spring of 1962, and since then its wheel has not turned once."
P2 = "A group of neighbours now wants to repair it, and has collected enough money for the first beam."
P3 = "They meet on Saturdays, bring their own tools and share what they have cooked at home."

PAGES = {
    "heading and two paragraphs in unnamed divs": f"<html><body><div><div><h1>§The mill</h1><div>§{P1}</div><div>§{P2}</div></div></div></body></html>",
    "heading and two paragraphs in hashed divs": f'<html><body><div class="css-1f9a0b"><div class="css-77ac01"><h2>§The mill</h2><p>§{P1}</p><p>§{P2}</p></div></div></body></html>',
    "one paragraph": f"<html><body><p>§{P1}</p></body></html>",
    "one paragraph and nothing else": f"<p>§{P1} {P2}</p>",
    "text of the body": f"<html><body>§{P1} {P2} {P3}</body></html>",
    "menu of words": f"<html><body><div>Home | Products | About</div><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p><div>Copyright 2023 Acme Ltd</div></body></html>",
    "menu of links": f'<html><body><div><a href="/">Home</a> | <a href="/p">Products</a> | <a href="/a">About</a></div><div><h1>§The mill</h1><p>§{P1}</p><p>§{P3}</p></div></body></html>',
    "comments without names": f"<html><body><div><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p></div><div><h3>2 comments</h3><div><b>Ben</b> wrote: I remember the sound of it.</div><div><b>Ida</b> wrote: My aunt worked there for years.</div></div></body></html>",
    "four comments in hashed divs": f'<html><body><div class="x1"><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p><p>§{P3}</p></div><div class="x2"><h4>Comments</h4><div class="x3"><span>Ben, 3 May 2021</span><p>I remember the sound of it very well.</p></div><div class="x3"><span>Ida, 4 May 2021</span><p>My aunt worked there for years and years.</p></div><div class="x3"><span>Tom, 4 May 2021</span><p>Count me in for Saturday.</p></div><div class="x3"><span>Eva, 6 May 2021</span><p>Is there a way to send money?</p></div></div></body></html>',
    "an advert link": f'<html><body><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p><p><a href="/shop">Buy our flour now</a></p></body></html>',
    "footer in a paragraph": f"<html><body><h1>§The mill</h1><p>§{P1}</p><p>§{P3}</p><p>© 2020 Mill Friends. All rights reserved.</p></body></html>",
    "list in a short text": f"<html><body><h2>§What we need</h2><p>§{P3}</p><ul><li>§two saws</li><li>§a long rope</li><li>§dry oak</li></ul></body></html>",
    "site name above": f'<html><body><div><a href="/">Mill Friends</a></div><div><h1>§The wheel</h1><p>§{P1}</p></div></body></html>',
    "cookie bar above": f"<html><body><div><p>We use cookies on this site.</p><button>OK</button></div><div><div><h1>§The wheel</h1><p>§{P1}</p><p>§{P2}</p></div></div></body></html>",
    "subheadings": f"<html><body><div><h1>§The mill</h1><h2>§Then</h2><p>§{P1}</p><h2>§Now</h2><p>§{P2}</p></div><div>Copyright 2019 Mill Friends</div></body></html>",
    "three short notes": "<html><body><h1>§Notes</h1><p>§The beam has come.</p><p>§It rained on Sunday.</p><p>§We begin again in May.</p></body></html>",
    "nested without names": f"<html><body><div><div><div><div><h1>§The mill</h1></div><div><p>§{P1}</p></div><div><p>§{P2}</p></div></div></div></div></body></html>",
    "related links below": f'<html><body><div><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p></div><div><h3>Related</h3><ul><li><a href="/1">The bridge</a></li><li><a href="/2">The ferry</a></li></ul></div></body></html>',
    "form below": f"<html><body><div><h1>§The mill</h1><p>§{P1}</p><p>§{P2}</p></div><form><label>E-mail</label><input><button>Subscribe</button></form></body></html>",
    "line breaks": f"<html><body>§{P1}<br><br>§{P2}<br><br>§{P3}</body></html>",
}
