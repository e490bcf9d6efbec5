"""Training-data operators: scoring, toxicity, token files, packing, joins, chat, mixing, licences, audio, search."""
