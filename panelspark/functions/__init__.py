"""Column functions: arithmetic with guards, ordered crosswalks, labels and bands."""
