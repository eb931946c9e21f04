"""Column helpers and the distributed order statistics built from them."""
