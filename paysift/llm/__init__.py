"""Training-data operators (numbered 1-13). Nothing else in the library imports this subpackage."""
