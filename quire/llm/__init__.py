"""Training-data operators (URL filters, token counts, decontamination, packing, similarity joins,
classifiers, record output, HTML extraction).  Nothing else in the library imports this subpackage."""
