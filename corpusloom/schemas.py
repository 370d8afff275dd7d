"""Fixed schemas of the data model."""

from __future__ import annotations

#: One dense score record per document (JSON lines).
DENSE = "doc_id string, tokens array<bigint>, topk_idx array<array<bigint>>, topk_logprobs array<array<float>>, loss_mask array<tinyint>"
#: Documents of a shard; ``topk_w`` holds values rounded to half precision, ``tail_w`` the mass outside them.
SHARD = "shard_id string, doc_id bigint, tokens array<bigint>, topk_idx array<array<bigint>>, topk_w array<array<float>>, tail_w array<float>, loss_mask array<tinyint>"
#: One manifest row per shard.
MANIFEST = "shard_id string, format_version int, k int, teacher_id string, quantization string, chat_template_version string, fold_version string, text_source string, logit_source string, data_class string, alpha_override double, vocab_size bigint, total_tokens bigint, num_documents bigint, doc_offsets array<bigint>, doc_lengths array<bigint>"
#: Positions and chunks of a bulk scored file.
BULK = "file string, pos bigint, token bigint, teacher_ids array<int>, teacher_probs array<float>, loss_mask tinyint"
CHUNKS = "file string, chunk int, start bigint, length bigint"
