from textquarry.llm import splitting


def test_first_piece_has_the_stored_header():
    header = "| масса | длина |\n| --- | --- |"
    rows = "".join(f"| {n},5 | {n * 7} |\n" for n in range(10, 300))
    intro = "Размеры приведены в таблице. " * 3 + "\n"
    for before in ("", intro, intro * 12):
        text = before + rows
        pieces = splitting.split_text(text, header)
        assert "".join(text[a:b] for a, b, _ in pieces) == text and all(len(p) // 3 <= 400 for _, _, p in pieces)
        tables = [p for a, b, p in pieces if b > len(before)]
        assert len(tables) > 1 and all(p.startswith(header) and p.count(header) == 1 for p in tables)
    for kept in (header + "\n", "|масса|длина|\n", "| Масса | длина |\n|---|---|\n", "| масса | длииа |\n"):
        first = splitting.split_text(kept + rows, header)[0][2]
        assert first.startswith(kept) and "масса" not in first[len(kept) :]
