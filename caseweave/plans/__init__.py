"""How plans are cut, sized and spread; and the views the operators read."""
