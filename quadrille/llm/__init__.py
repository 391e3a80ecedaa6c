"""Training-data operators: one module for each, used only through this subpackage."""
