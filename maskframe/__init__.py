"""DataFrame operators for annotated images held as tables of pixels, boxes and labels."""
