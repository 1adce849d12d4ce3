"""Texts that every operator on texts must survive."""

TEXTS = [None, "", " ", "\n\n", "one", "One two\tthree\x0bfour\r\nfive", "a  b   c\n\n\nd ", "naïve café   日本語 😀 ÀÉ", "é x\x1cy\x85z​   end", "$1 \\ %_ ' \"", "w " * 400, "ab" * 3000, " ".join(f"w{i % 97}x{i % 13}" for i in range(20_000))]
