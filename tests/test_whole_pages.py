from symgraph.operators import html


def test_pages_are_converted_whole(spark):
    body = "<p>" + "word " * 60_000 + "</p><h2>End</h2>"
    assert html.to_markdown(f"<html><head><style>{'x' * 150_000}</style></head><body>{body}</body></html>").endswith("\n\n## End")
    assert len(html.to_markdown(f"<body>{body}</body>")) > 290_000
    assert html.to_markdown(body).endswith("\n\n## End")
