"""Site templates do not depend on the size of their host."""

from __future__ import annotations

from saleroom.llm import pages


def test_templates_of_a_large_host(spark, frame):
    page = "<html><body>{}<div><p>Story {} in full.</p></div></body></html>"
    rows = [(k, f"https://a.example/{k}", page.format("<div><p>Our offer</p></div>" if k < 5 else "", k)) for k in range(600)]
    found = {r["page_id"]: r["text"] for r in pages.main_text(frame("page_id BIGINT, url STRING, html STRING", *rows)).collect()}
    assert found == {k: f"Story {k} in full." for k in range(600)}
