#: Corner rows: null id, null text, empty and long text, repeated rows, repeated id, odd characters.
ODD = [(None, "a row without an id a row"), (7, None), (8, ""), (9, "  \n\t "), (10, "Alpha beta gamma delta epsilon zeta"),
       (11, "Alpha beta gamma delta epsilon zeta"), (11, "Alpha beta gamma delta epsilon zeta"), (11, "another text under one id é日 ﬁ"),
       (12, "word " * 30_000), (13, "x" * 50_000), (14, "ΑΣ İ́ ▁ \u0000 <|endoftext|> \U0001f600 don't 1234,5")]
