"""Operators for preparing training text at scale, one module each.

near_dedup     bottom-k MinHash near-duplicate components            (op1)
repeats        run-length-index removal of long repeated passages    (op2)
secrets        random-forest secret scan                             (op3)
bpe            byte-level BPE encoding and decoding                  (op4)
sharding       Hilbert-curve sharding                                (op5)
quality        threshold-table quality rules                         (op6)
language       language identification with rejection                (op7)
toxicity       FTRL toxicity scores                                  (op8)
token_counts   offset-mapped token counts per section                (op9)
decontaminate  positional inverted index of benchmark passages       (op10)
url_filter     Bloom filter cascade over the corpus's addresses      (op11)
spelling       words one edit apart, by prefix-suffix tiles          (op12)
conversations  repair of damaged conversations by an audit DP        (op13)

``queries`` registers one query per operator. Nothing outside this folder (and
``corpus_pipeline.py``) imports it.
"""
